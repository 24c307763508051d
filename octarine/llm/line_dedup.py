"""Line dedup: repeated runs of lines, found by prefix doubling over line numbers; later copies are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from octarine.llm.common import SPACES, cut, fresh, let, table

#: Words that a repeated run must have in all to be deleted.
MIN_WORDS = 10


def _n_words(line: Column, most: int) -> Column:
    """Words of the line, or most if it has more: then only so many are looked at."""
    many = line.rlike(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (most - 1))
    exact = F.size(F.array_remove(F.split(F.translate(line, SPACES[1:], " " * 5), " "), ""))
    return F.when(many, F.lit(most)).otherwise(exact)


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line with a word: gid, doc_id, key, pos, n, h1, h2, n_words.

    gid grows with (doc_id, key, pos), and by one from a line to the next of its document. key tells rows of one
    doc_id with different texts apart; rows alike in both are taken once. pos is the line's number among all n lines.
    n_words counts to min_words only, since no sum that matters needs more.
    """
    cut_up = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.split("text", "\n").alias("lines"))
    rows = cut_up.select("doc_id", "key", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc_id", "key", "pos", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), _n_words(F.col("line"), min_words).alias("n_words")).where("n_words > 0")
    placed = rows.dropDuplicates(["doc_id", "key", "pos"]).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "pos")
    return cut(placed.withColumn("gid", F.monotonically_increasing_id()))


def _blocks(lines: DataFrame, min_words: int) -> DataFrame:
    """lines with left, upto, and ahead and back: the least number of lines from here on, and up to here, with min_words words in all; null if there are too few."""
    own = W.partitionBy("doc_id", "key")
    down, up = own.orderBy("pos"), own.orderBy(F.desc("pos"))
    counted = lines.withColumns({"at": F.row_number().over(down), "sum": F.sum("n_words").over(down.rowsBetween(W.unboundedPreceding, 0)), "rest": F.sum("n_words").over(up.rowsBetween(W.unboundedPreceding, 0)), "upto": F.coalesce(F.lead("pos").over(down), "n"), "left": F.row_number().over(up)})
    before = F.max("at").over(own.orderBy("sum").rangeBetween(W.unboundedPreceding, -min_words))
    behind = F.min("at").over(own.orderBy("rest").rangeBetween(W.unboundedPreceding, -min_words))
    back = F.when(F.col("sum") >= min_words, F.col("at") - F.coalesce(before, F.lit(0)))
    ahead = F.when(F.col("rest") >= min_words, F.coalesce(behind, F.col("at") + F.col("left")) - F.col("at"))
    return counted.withColumns({"back": back, "ahead": ahead}).drop("at", "sum", "rest", "n", "n_words")


def repeated_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(gid, length): line blocks of min_words words or more that stand earlier too; together they are all repeated runs.

    A run of lines with min_words words that has an earlier copy is the union of its least blocks: those that start at
    each of its lines, and those that end there. So lines need classes of the lengths of such blocks only.

    Prefix doubling: two lines are in one class of length 1 if they are equal, and in one of length 2k if both the
    k lines from each and the k lines after those are in one class. The name of a class is its least gid, and a class
    of one line is dropped, with all longer ones there. A class of 2k lines is an interval of the suffix array
    in which the common prefix is 2k or more; a block of another length is met as two overlapping classes. A block is
    an earlier one's copy if the least gid of its class is less than its own. A line has one word at least, so blocks have
    min_words lines at most and the doubling ends. Each round is joins on gid and partial aggregations, which a
    line in a third of all documents can't gather in one task: what is aggregated is written before it is joined, so
    that both sides of the join are exchanged and a crowded key can be split.
    """
    lines = cut(_blocks(suffixes(docs, min_words), min_words))
    starts = lines.where("ahead is not null").select("gid", F.col("ahead").alias("length"))
    ends = lines.where("back is not null").select((F.col("gid") - F.col("back") + 1).alias("gid"), F.col("back").alias("length"))
    blocks = cut(starts.union(ends).distinct())
    first = cut(lines.groupBy("h1", "h2").agg(F.min("gid").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    classes = cut(lines.select("gid", "left", "h1", "h2").join(first, ["h1", "h2"]).select("gid", "left", "name"))
    found, size = None, 1
    while size <= min_words:
        here = blocks.where((F.col("length") >= size) & (F.col("length") < 2 * size))
        a = classes.select("gid", F.col("name").alias("a"))
        b = classes.select(F.col("gid").alias("gid_b"), F.col("name").alias("b"))
        met = cut(here.join(a, "gid").withColumn("gid_b", F.col("gid") + F.col("length") - size).join(b, "gid_b").select("gid", "length", "a", "b"))
        least = cut(met.groupBy("a", "b", "length").agg(F.min("gid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        copies = cut(met.join(least, ["a", "b", "length"]).where("least < gid").select("gid", "length"))
        found = copies if found is None else found.union(copies)
        if 2 * size > min_words:
            break
        pairs = classes.where(F.col("left") >= 2 * size).join(b.withColumn("gid", F.col("gid_b") - size).drop("gid_b"), "gid").select("gid", "left", F.col("name").alias("a"), "b")
        pairs = cut(pairs)
        names = cut(pairs.groupBy("a", "b").agg(F.min("gid").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        classes = cut(pairs.join(names, ["a", "b"]).select("gid", "left", "name"))
        size *= 2
        if classes.isEmpty():
            break
    gone = found.select(F.explode(F.sequence(F.col("gid"), F.col("gid") + F.col("length") - 1)).alias("gid")).distinct()
    return lines.join(gone, "gid").select("doc_id", "key", "pos", "upto")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less the lines of repeated runs, and with n_lines and n_removed.

    A run of lines with min_words words or more in all is deleted where the same lines stand earlier, in the order of
    doc_id (nulls first) and line number, overlaps included: what stays is each run's first copy. Runs are judged on the input, and don't cross documents. Lines
    without a word are ignored between lines, and go or stay with the line before them. A null text stays null, with
    no lines; an empty one has one line. Rows alike in doc_id and text are taken as one, and come back alike. An empty
    table gives an empty one. Extra columns stay as they are, whatever their names, but for n_lines and n_removed, which are replaced.
    """
    gone = repeated_blocks(docs.select("doc_id", "text"), min_words)
    span = F.sequence(F.col("pos"), F.col("upto") - 1)
    id_, key, cut_, own_ = fresh(docs, 4)
    cuts = gone.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list(span))).alias(cut_)).select(F.col("doc_id").alias(id_), F.col("key").alias(key), cut_)
    own = docs.withColumn(own_, F.xxhash64("doc_id", "text"))
    met = own.join(cuts, (F.col(own_) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    split = F.split("text", "\n")
    n = F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(split)), F.lit(0)).cast("bigint")
    stay = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(cut_)), lambda k: x[k]), "\n")
    text = F.when(F.col(cut_).isNull(), F.col("text")).otherwise(let(split, stay))
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return met.select(*kept, text.alias("text"), n.alias("n_lines"), F.coalesce(F.size(cut_), F.lit(0)).cast("bigint").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) ls from documents),
u as (select doc_id, ls, unnest(range(len(ls))) pos from d where text is not null),
l as (select doc_id, pos, ls[pos + 1] line, len(ls) n,
    len(list_filter(regexp_split_to_array(ls[pos + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '')) w from u),
k as (select *, row_number() over (partition by doc_id order by pos) i, coalesce(lead(pos) over (partition by doc_id order by pos), n) upto,
    sum(w) over (partition by doc_id order by pos) s from l where w > 0),
b as (
  select a.doc_id, a.i i, min(z.i) j from k a join k z on a.doc_id = z.doc_id and z.i between a.i and a.i + 9 and z.s - a.s + a.w >= 10 group by all
  union
  select z.doc_id, max(a.i), z.i from k a join k z on a.doc_id = z.doc_id and a.i between z.i - 9 and z.i and z.s - a.s + a.w >= 10 group by z.doc_id, z.i),
c as (select b.doc_id, b.i, b.j, string_agg(k.line, chr(10) order by k.i) t from b join k on k.doc_id = b.doc_id and k.i between b.i and b.j group by all),
r as (select *, row_number() over (partition by t order by doc_id, i) = 1 is_first from c),
g as (select distinct k.doc_id, unnest(range(k.pos, k.upto)) pos from r join k on k.doc_id = r.doc_id and k.i between r.i and r.j where not is_first),
s as (select u.doc_id, string_agg(u.ls[u.pos + 1], chr(10) order by u.pos) t from u left join g on g.doc_id = u.doc_id and g.pos = u.pos where g.pos is null group by u.doc_id),
x as (select doc_id, count(*) n from g group by 1)
select d.doc_id, coalesce(len(d.ls), 0)::bigint n_lines, coalesce(x.n, 0)::bigint n_removed, case when d.text is null then null else coalesce(s.t, '') end as text
from d left join s on s.doc_id = d.doc_id left join x on x.doc_id = d.doc_id
"""
