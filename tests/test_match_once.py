"""Matching by place: each side is dealt out once; places of many boxes go by cells."""
import random

import pytest
from pyspark.sql import functions as F

from annolake.operators import matching


def boxes(spark, seed, n=160):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y = rng.choice((0.0, 3.0, 7.5, 40.0, None)), rng.choice((0.0, 4.9, 5.0, 90.0))
        rows.append((rng.choice(("D", "E", None)), rng.choice((1, 2, None)), rng.choice((i, i, None, 4)), rng.choice(("a", "A", "b", None)), x, y))
    df = spark.createDataFrame(rows, "doc_id string, page int, annot_idx long, content string, x double, y double")
    return df.select("doc_id", "page", "annot_idx", "content", F.struct(
        F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 9).alias("x1"), (F.col("y") + 9).alias("y1")).alias("rect"))


@pytest.mark.parametrize("many", [256, 3, 0])
def test_every_pair_is_looked_at(spark, monkeypatch, many):
    monkeypatch.setattr(matching, "MANY", many)
    new, old = boxes(spark, 1), boxes(spark, 2)
    held = old.collect()

    def found(r):
        if None in (r.doc_id, r.page, r.content, r.rect.x0):
            return None
        return min((h.annot_idx for h in held if (h.doc_id, h.page) == (r.doc_id, r.page) and h.content and h.content.upper() == r.content.upper()
                    and h.annot_idx is not None and h.rect.x0 is not None and all(abs(a - b) < 5 for a, b in zip(h.rect, r.rect))), default=None)
    out = matching.match_positions(new, old).collect()
    assert sorted(map(repr, ((*r[:-1], r.match_idx) for r in out))) == sorted(map(repr, ((*r, found(r)) for r in new.collect())))


def test_a_side_is_dealt_out_once(spark):
    out = matching.match_positions(boxes(spark, 1), boxes(spark, 2))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the count of a place's boxes is a hash; nothing else but the lists of places and the boxes travel
    assert plan.count("Exchange hashpartitioning(doc_id") <= 2 and "sequence(" not in plan
