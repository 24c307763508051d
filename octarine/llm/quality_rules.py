"""Quality rules: word statistics in SQL expressions, and a decision list learned from labelled ones."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octarine.llm.common import SPACES, cut, fresh, let, lower_ascii, table

#: The characters that count as symbols, and a character of a word.
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
#: What a learned condition may look at.
FEATURES = ("flagged", "n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "mark_rate", "digit_rate")
#: The columns that statistics() makes.
STATISTICS = ("flagged", "n_words", "n_repeat_words", "n_distinct", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits", "base_failed", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "mark_rate", "digit_rate")
#: The most labelled rows that the list is fitted on; those with the least hash of their doc_id are taken.
MOST_LABELLED = 20_000
#: Words that tell bad texts: how many at most, the share of labelled bad texts in which each must stand (and five texts), and the share of bad ones among its texts.
MOST_FLAGGED, LEAST_SUPPORT, LEAST_SHARE = 300, 0.015, 0.9
#: A bad text of more different words is no evidence for any of them: too many stand in it by chance.
MOST_DIFFERENT = 1000
#: What is left out of a word before it is looked up.
MARKS = ".,;:!?\"'()[]"


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that the array holds twice or more."""
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))

    def starts(s: Column) -> Column:  # s: sorted by hash; equal neighbours are repeats
        twin = lambda x, i: F.when(i > 0, s[i - 1]["h"] == x["h"]).otherwise(False) | F.when(i + 1 < F.size(s), s[i + 1]["h"] == x["h"]).otherwise(False)
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = lambda x, j: F.when(j + 1 < F.size(p), F.least(F.lit(3), p[j + 1] - x)).otherwise(3)
        return F.aggregate(F.transform(p, step), F.lit(0).cast("bigint"), lambda a, x: a + x)

    counted = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(F.transform(g, pair)), lambda s: let(starts(s), covered)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(grams(words), counted))


def _number_of(text: Column, pattern: str) -> Column:
    """How many characters of the class there are."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _bare_words(text: Column) -> Column:
    """Words in lower case, without marks."""
    return F.split(F.translate(lower_ascii(text), SPACES[1:] + MARKS, " " * 5), " ")


def statistics(docs: DataFrame, text: str = "text", flagged: Sequence[str] = ()) -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, flagged and the rates.

    flagged counts the words of the given list, in any case and with marks around them. Every number is of the whole text; a null or empty text has zeros, and fails. Rates over no words or lines are 0.
    Rows stand alone: repeated rows and extra columns come back as they are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, SPACES[1:], " " * 5), " "), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    kept = [c for c in docs.columns if c not in {text, *STATISTICS}]
    seen = F.size(F.filter(_bare_words(t), lambda w: w.isin(*flagged))) if flagged else F.lit(0)
    w_, l_, t_ = fresh(docs, 3)
    got = docs.select(*kept, let(words, of).alias(w_), let(lines, of_lines).alias(l_), F.struct(seen.cast("bigint").alias("flagged"), F.length(F.translate(t, SPACES, "")).cast("bigint").alias("word_chars"), _number_of(t, "[#*$%&|<>]").alias("n_symbols"), _number_of(t, r"\p{Lu}").alias("n_upper"), _number_of(t, r"[!?]").alias("n_marks"), _number_of(t, r"[0-9]").alias("n_digits")).alias(t_))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    own = {c: F.col(f"{s}.{c}") for s, cs in ((w_, ("n_words", "n_repeat_words", "n_distinct")), (l_, ("n_lines", "n_dup_lines")), (t_, ("flagged", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits"))) for c in cs}
    flat = got.select(*kept, *[c.alias(n) for n, c in own.items()])
    return flat.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mean_word": rate("word_chars", "n_words"),
            "symbol_rate": rate("n_symbols", "n_words"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "distinct_rate": rate("n_distinct", "n_words"),
            "upper_rate": rate("n_upper", "word_chars"),
            "mark_rate": rate("n_marks", "n_words"),
            "digit_rate": rate("n_digits", "word_chars"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def _grow(rows: list[dict], features: tuple[str, ...], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    """A conjunction for the bad rows: again and again the condition of the largest gain in information."""
    rule: list[Condition] = []
    inside = rows
    while len(rule) < most:
        p, n = sum(r["bad"] for r in inside), sum(not r["bad"] for r in inside)
        if not p or not n:
            break
        best, gain = None, 0.0
        for f in features:
            order = sorted((r[f], r["bad"]) for r in inside)
            k = below_p = below_n = 0
            for c in cuts[f]:
                while k < len(order) and order[k][0] <= c:
                    below_p, below_n, k = below_p + order[k][1], below_n + (not order[k][1]), k + 1
                for above, a, b in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                    g = a * (math.log2(a / (a + b)) - math.log2(p / (p + n))) if a else 0.0
                    if g > gain + 1e-9:
                        best, gain = Condition(f, above, c), g
        if best is None:
            break
        rule.append(best)
        inside = [r for r in inside if best.holds(r)]
    return rule


def _prune(rule: list[Condition], rows: list[dict]) -> tuple[list[Condition], float, int]:
    """The prefix of the rule that is worth most on rows it was not grown on; its precision and number of rows there."""
    best = (-1.0, rule, 0.0, 0)
    inside = rows
    for k, c in enumerate(rule, 1):
        inside = [r for r in inside if c.holds(r)]
        p = sum(r["bad"] for r in inside)
        worth = (2 * p - len(inside)) / (len(inside) + 1)
        if worth > best[0] + 1e-9:
            best = (worth, rule[:k], p / max(1, len(inside)), len(inside))
    return best[1:]


def learn(rows: list[dict], features: tuple[str, ...] = FEATURES, max_rules: int = 12, max_conditions: int = 4, n_cuts: int = 200, precision: float = 0.9) -> list[list[Condition]]:
    """Sequential covering: a rule is grown on two thirds of the rows and pruned on the rest, and what it covers is left out.

    Each third is the rest once, which gives up to three rules; of those that are right on the given share of the rest, and of all
    that they cover, the one that covers the most bad rows is taken. The list ends when there is none. rows: features
    and bad (bool), dealt to the thirds by their order. No bad rows give no rules.
    """
    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < max_rules and any(r["bad"] for r in left):
        cuts = {}
        for f in features:
            values = sorted({r[f] for r in left})
            steps = {int(k * (len(values) - 1) / n_cuts) for k in range(n_cuts)} if len(values) > 1 else set()
            cuts[f] = [(values[k] + values[k + 1]) / 2 for k in sorted(steps)]
        best: tuple[int, list[Condition]] = (0, [])
        for fold in range(3):
            rule = _grow([r for k, r in enumerate(left) if k % 3 != fold], features, cuts, max_conditions)
            if not rule:
                continue
            rule, right, n = _prune(rule, left[fold::3])
            inside = [r["bad"] for r in left if all(c.holds(r) for c in rule)]
            if n and right >= precision and sum(inside) >= precision * len(inside) and sum(inside) > best[0]:
                best = sum(inside), rule
        if not best[0]:
            break
        rules.append(best[1])
        left = [r for r in left if not all(c.holds(r) for c in best[1])]
    return rules


def some_labelled(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(id, bad) of at most so many labelled rows, those of the least hash of doc_id: bad if quality is 0 or, where there is such a column, toxic is 1; without either the row is left out."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None).cast("int")
    known = labels.select(F.col("doc_id").alias("id"), F.coalesce((F.col("quality") == 0), F.lit(False)).alias("poor"), F.coalesce(toxic == 1, F.lit(False)).alias("toxic"), (F.col("quality").isNotNull() | toxic.isNotNull()).alias("known"))
    some = known.where("known and id is not null").groupBy("id").agg(F.bool_or(F.col("poor") | F.col("toxic")).alias("bad"))
    return some.orderBy(F.xxhash64("id"), "id").limit(most)


def telling_words(docs: DataFrame, some: DataFrame) -> list[str]:
    """The MOST_FLAGGED commonest of the words that stand in bad texts (bad of some, by id) and in hardly any other.

    Words of little support are left out, as what copies of one text share would else tell that text.
    """
    at, bad = fresh(docs, 2)
    met = docs.join(F.broadcast(some.select(F.col("id").alias(at), F.col("bad").alias(bad))), F.col("doc_id") == F.col(at))
    own = met.select(F.col(at).alias("id"), F.col(bad).alias("bad"), F.array_distinct(_bare_words(F.coalesce("text", F.lit("")))).alias("words")).where((~F.col("bad")) | (F.size("words") <= MOST_DIFFERENT))
    rows = own.select("id", "bad", F.explode("words").alias("word")).where("word != ''").distinct()
    least = max(5.0, LEAST_SUPPORT * some.where("bad").count())
    n = rows.groupBy("word").agg(F.count_if("bad").alias("p"), F.count(F.lit(1)).alias("n")).where((F.col("p") >= least) & (F.col("p") >= LEAST_SHARE * F.col("n")))
    return [r.word for r in n.orderBy(F.desc("p"), "word").limit(MOST_FLAGGED).collect()]


def labelled(stats: DataFrame, some: DataFrame, most: int = MOST_LABELLED) -> list[dict]:
    """The features of the labelled rows of stats, with bad; repeated rows of one id count each, up to most in all."""
    at, bad = fresh(stats, 2)
    met = stats.join(F.broadcast(some.select(F.col("id").alias(at), F.col("bad").alias(bad))), F.col("doc_id") == F.col(at))
    got = met.select(F.col(at).alias("id"), F.col(bad).alias("bad"), *[F.col(f).cast("double").alias(f) for f in FEATURES])
    return [r.asDict() for r in got.orderBy(F.xxhash64("id"), "id", *FEATURES).limit(most).collect()]


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, from 1; 0 if none does."""
    found = F.lit(0)
    for k in range(len(rules), 0, -1):
        held = rules[k - 1][0].column()
        for c in rules[k - 1][1:]:
            held = held & c.column()
        found = F.when(held, k).otherwise(found)
    return found


def judge(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """statistics() of docs with failed_rule (0: none) and kept: not base_failed, and no learned rule holds.

    labels: doc_id, quality (0: bad) and perhaps toxic (1: bad); without any there are no rules. The statistics are written once
    to the checkpoint folder. Extra columns stay, but for those of the names made here. Nulls in labels count as not
    known; a doc_id labelled twice is bad if one row says so.
    """
    some = cut(some_labelled(labels, most))
    stats = cut(statistics(docs.drop("failed_rule", "kept"), flagged=telling_words(docs, some)))
    judged = stats.withColumn("failed_rule", verdict(learn(labelled(stats, some, most))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rule") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = judge(docs, table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")
