"""Texts that need no cleaning take a short way; it gives what the long one gives, and fixed patterns stay fixed."""

import re

from pyspark.sql import functions as F

from paperloom.functions import text as T

ODD = ["", " ", "a", "a b", " a b", "a  b", "a b ", "a\tb", "A B", "﻿a", "a\n", "a?b??c???", "???", "what? is? this? about, then", "�", "a�b", "naïve  text", "公式 损失", "x" * 20_000, "a " * 20_000 + "b", "a;b; A ;a", "one/ two ,two|THREE;;three", "n/a; none; ok", "World Model, sac", "PPO\nrl-based", "A*", "spac", "PPO\n", None]
SPACES = r"[\s﻿\x85\xa0]+"


def keys(values):
    return [re.sub(SPACES, " ", v.lower()).strip(" ") for v in values]


def test_short_ways_give_what_long_ones_give(spark):
    t = F.col("t")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, t string").select("i", T.readable(t).alias("readable"), T.key_of(t).alias("key"), T.values_of(t).alias("listed"), T.methods_of(t, F.lit(None).cast("string"), t, F.lit("")).alias("methods"))
    for r in df.collect():
        x = ODD[r.i] or ""
        clean = re.sub(SPACES, " ", x.replace("�", "")).strip(" ")
        assert r.readable == ("" if clean.count("?") >= max(3.0, len(clean) * 0.35) else clean), r.i
        if ODD[r.i] is None:
            assert r.key is None and r.methods == []
            continue
        assert r.key == keys([x])[0], r.i
        parts = [re.sub(rf"^{SPACES}|{SPACES}$", "", p) for p in re.split(T.SEPARATORS, x)]
        parts = [p for p in parts if 2 <= len(p) <= 60 and not re.search(T.NOTHING, p)]
        distinct = lambda vs: [v for v, k, i in zip(vs, keys(vs), range(len(vs)), strict=True) if k and keys(vs).index(k) == i]
        assert r.listed == distinct(parts), r.i
        hinted = [h for h in T.METHOD_HINTS if re.search(f"(?i)(^|[^A-Za-z0-9]){re.escape(h)}([^A-Za-z0-9]|$)", f"{x}  {x} ")]
        assert r.methods == distinct(hinted + parts), r.i


def test_no_pattern_is_put_together_for_a_row(spark):
    df = spark.createDataFrame([("a",)], "t string").select(T.methods_of(*[F.col("t")] * 4).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "concat((?i)" not in plan and "RLIKE" in plan
