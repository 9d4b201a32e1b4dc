"""URL thresholds on held-out URLs, totals beside a compaction, and what near-duplicate classes send to blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import near_dedup, token_rollup, url_filter


def test_threshold_balances_errors_unless_too_many_accepted_are_missed(spark):
    rng = np.random.default_rng(3)
    good, bad = np.round(rng.normal(1, 1, 900), 3).tolist(), np.round(rng.normal(-1, 1, 300), 3).tolist()
    df = spark.createDataFrame([("allow", x, 1) for x in good] + [("block", x, 2) for x in bad], "verdict string, score double, n long")
    blocked = lambda t: sum(x < t for x in good) / len(good)
    passed = lambda t: sum(x >= t for x in bad) / len(bad)
    free, strict = url_filter.threshold(df, 1.0), url_filter.threshold(df, 0.02)
    assert abs(blocked(free) - passed(free)) < 0.02 and blocked(free) > 0.05
    assert blocked(strict) <= 0.02 < blocked(strict + 0.1) and strict < free
    assert url_filter.threshold(df.where("verdict = 'block'"), 0.1) == 0.0


def test_miss_changes_verdicts_and_held_out_urls_are_blocked_at_about_that_rate(spark):
    """Accepted and rejected paths that overlap, with rules for hosts that say nothing themselves."""
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    hosts = [f"{''.join(rng.choice(list('tuvwxyz'), 5))}.test" for _ in range(240)]
    rules = [("allow" if i % 2 else "block", h, "/") for i, h in enumerate(hosts)]
    urls = [f"http://{h}/{word('abcdefg' if i % 2 else 'bcdefgh')}" for i, h in enumerate(hosts)] + [f"http://yxz.test/{word('abcdefgh')}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(urls))), "page_id long, url string")
    held, shares = F.pmod(F.xxhash64("url"), F.lit(url_filter.HELD_OUT)) == 0, []
    for miss in (0.0, 0.1, 1.0):
        out = url_filter.judge(df, rules=rules, miss=miss).join(df, "page_id").cache()
        free, kept = out.where("rule is null"), out.where(held & F.col("rule").isNotNull() & (F.col("verdict") == "allow"))
        shares.append(free.where("verdict = 'block'").count() / free.count())
        lowest = free.where("verdict = 'allow'").agg(F.min("score")).first()[0]
        missed = kept.where(F.col("score") < lowest - 0.02).count() / kept.count()
        assert missed <= miss + 0.02
    assert shares[0] < shares[1] < shares[2] < 0.9, shares


def test_totals_hold_over_a_compaction(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    change = lambda n: spark.createDataFrame([("s", "en", "words", None, n)], "source string, lang string, tokenizer string, old_tokens long, new_tokens long")
    for i in range(2):
        r.commit(f"a{i}", change(5))
    early = r.totals()
    r.compact()
    assert [tuple(x) for x in early.collect()] == [("s", "en", "words", 2, 10)]
    r.commit("a0", change(5))  # still known
    r.commit("b", change(7))
    middle = r.totals()
    r.compact()
    assert middle.first()["tokens"] == 17 and r.totals().first()["tokens"] == 17
    r.commit("c", change(1))
    r.compact()
    names = {p.name for p in (tmp_path / "r").iterdir()}
    assert not {"batch-a0", "batch-a1", "batch-b"} & names and "batch-c" in names and sum(n.startswith("snapshot-") for n in names) == 2
    r.commit("a1", change(5))
    assert r.totals().first()["tokens"] == 18


@pytest.mark.parametrize("lone", [1, 7])
def test_only_members_outside_the_largest_class_visit_all_blocks(spark, lone):
    n, rows = 800, 40
    bits = F.array(F.lit(0).cast("long"))
    tested = spark.range(1, n + 1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("centre"), F.lit(0.9).alias("similarity"), bits.alias("lost"), bits.alias("extra"), F.lit(1).cast("long").alias("weight"))
    comps = spark.range(1, n + 1 - lone).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("comp"))
    chars = spark.range(0, n + 1).select(F.col("id").alias("node"), F.lit(10).alias("chars"))
    met = near_dedup.meetings(tested, comps, chars, block_rows=rows)
    assert met.count() == n + lone * n // rows
    assert met.where("streams").select("node").distinct().count() == lone and met.where("not streams").count() == n
    assert near_dedup.meetings(tested.where(f"node <= {n - lone}"), comps, chars, block_rows=rows).isEmpty()
