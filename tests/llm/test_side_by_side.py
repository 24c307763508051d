"""Links and groups of two tokenizers' tokens against all pairs of byte ranges."""

import glob
import random
from functools import partial

import numpy as np
import pyarrow.parquet as pq

from octarine.llm import alignment
from octarine.llm.common import checkpoint_dir


def ranges(sizes):
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def test_links_are_all_overlaps_and_groups_end_where_both_do():
    own = alignment.aligner(alignment.BYTE_BPE, alignment.PIECE_BPE)
    texts = ["a", "naïve", "Übermäßigkeiten", "x=1;y[2]", "日本語です", "antidisestablishmentarianism", "3.14159", "a\nb", "two words", "🙂🙃"]
    lasting = 0
    for text in texts:
        a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        at_a, at_b = ranges([len(own.a_bytes[k]) for k in a]), ranges([len(own.b_bytes[k]) for k in b])
        met = own._aligned(text, a, b)
        if met is None:
            continue
        lasting += 1
        want = sorted(y << alignment.LOW | x for x, (i, j) in zip(a, at_a) for y, (k, m) in zip(b, at_b) if i < m and k < j)
        assert sorted(np.frombuffer(met.codes, np.int64).tolist()) == want and met.n_links == len(want)
        ends = sorted({j for _, j in at_a} & {j for _, j in at_b})
        side = lambda ids, at, lo, hi: ",".join(str(k) for k, (i, j) in zip(ids, at) if lo <= i and j <= hi)
        assert met.text == ";".join(f"{side(a, at_a, lo, hi)}|{side(b, at_b, lo, hi)}" for lo, hi in zip([0, *ends], ends)) and met.n_groups == len(ends)
        assert (met.n_a, met.n_b) == (len(a), len(b))
    assert lasting >= 7


def test_blocks_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    """Blocks are some megabytes, and all of a row group are held at once, as are the least and largest value of each: no group is to hold all blocks of a task."""
    r = random.Random(4)
    rows = [(k, " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(400))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, alignment.link_figures(docs).collect()))
    files = lambda: set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/alignment-*/blocks/*.parquet"))
    before, at_once = files(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(alignment, "gathered", partial(alignment.gathered, size=1))
    monkeypatch.setattr(alignment, "HELD", 1 << 16, raising=False)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        assert sorted(map(tuple, alignment.link_figures(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    found = [pq.ParquetFile(f).metadata for f in files() - before]
    assert sum(m.num_rows for m in found) == 20
    groups = [m.row_group(k) for m in found for k in range(m.num_row_groups)]
    assert max(g.num_rows for g in groups) <= 4
    assert not any(g.column(k).is_stats_set for g in groups for k in range(g.num_columns))
