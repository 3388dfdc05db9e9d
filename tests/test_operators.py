"""Operators on literal rows: published values, edge cases and properties."""

import hashlib
import math
import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import labels as L
from tallyspark.functions import tails
from tallyspark.functions.distributions import chi2_sf, pearson_p, t_sf
from tallyspark.operators import accuracy, agreement, composition, effects, efficiency, hypothesis, listeners, quality, resampling, sequence, splitting, worklist
from tallyspark.sources import bindings


def one(df):
    return df.collect()[0]


class TestDistributions:
    def test_known_values(self):
        for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05)):
            assert math.isclose(chi2_sf(x, df), p, abs_tol=1e-6)
        assert math.isclose(t_sf(2.776445, 4), 0.025, abs_tol=1e-6)
        assert math.isclose(pearson_p(-0.3173762747531234, 5), 0.6027943, abs_tol=1e-6)
        assert chi2_sf(0, 3) == 1.0 and pearson_p(0.5, 2) == 1.0 and math.isclose(t_sf(-1, 5) + t_sf(1, 5), 1)


class TestTails:
    """Column expressions against the plain functions, and published values."""

    def test_chi2(self, spark):
        rows = [(x, d) for d in (1, 2, 3, 4, 7, 30, 101, 500) for x in (1e-6, 0.3, 1.0, 3.841459, 20.0, 90.0, 140.0, 600.0, 1461.78)]
        got = spark.createDataFrame(rows, "x double, d int").select("x", "d", tails.chi2_p("x", "d").alias("p")).collect()
        for r in got:
            assert math.isclose(r.p, chi2_sf(r.x, r.d), rel_tol=1e-9, abs_tol=1e-13), r
        odd = spark.createDataFrame([(None, 1), (math.nan, 1), (-1.0, 2), (0.0, 2), (5.0, 0)], "x double, d int").select(tails.chi2_p("x", "d").alias("p")).collect()
        assert [r.p for r in odd] == [None, None, 1.0, 1.0, 1.0]

    def test_t_and_correlation(self, spark):
        rows = [(t, d) for d in (1, 2, 4, 10, 57, 1000, 100_000) for t in (-40.0, -2.776445, -0.01, 0.0, 0.5, 1.96, 8.0)]
        got = spark.createDataFrame(rows, "t double, d int").select("t", "d", tails.t_p("t", "d").alias("p")).collect()
        for r in got:
            assert math.isclose(r.p, 2 * t_sf(abs(r.t), r.d), rel_tol=1e-8, abs_tol=1e-13), r
        rows = [(-0.3173762747531234, 5), (-0.4, 5), (0.5, 2), (1.0, 9), (0.02, 5000), (0.0, 10), (None, 5)]
        got = [r.p for r in spark.createDataFrame(rows, "r double, n int").select(tails.correlation_p("r", "n").alias("p")).collect()]
        assert math.isclose(got[0], 0.6027943, abs_tol=1e-6) and got[2] == got[5] == 1.0 and got[3] == 0.0 and got[6] is None
        assert all(math.isclose(g, pearson_p(r, n), rel_tol=1e-9) for g, (r, n) in zip(got[:6], rows))

    def test_gamma(self, spark):
        x = [0.01, 0.5, 1.0, 2.0, 3.7, 10.0, 171.0, 1e6]
        got = [r.g for r in spark.createDataFrame([(v,) for v in x], "x double").select(tails.log_gamma("x").alias("g")).collect()]
        assert all(math.isclose(g, math.lgamma(v), rel_tol=1e-12, abs_tol=1e-12) for g, v in zip(got, x))

    def test_slope(self, spark):
        flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, y double")
        line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "x double, y double")
        noisy = spark.createDataFrame([(float(i), i + (-1.0) ** i * 3) for i in range(12)], "x double, y double")
        p = [one(hypothesis.with_slope_p(hypothesis.linear_regression(d))).p_value for d in (flat, line)]
        assert p[1] < 1e-9 and (p[0] is None or p[0] == 1.0)
        r = one(hypothesis.with_slope_p(hypothesis.linear_regression(noisy)))
        assert math.isclose(r.p_value, pearson_p(r.r, 12), rel_tol=1e-9)


class TestLabels:
    def test_valence(self, spark):
        rows = [("That's wonderful, thank you!", "positive"), ("I hate this terrible problem.", "negative"), ("The meeting is at 3pm.", "neutral"), ("know", "negative")]
        assert all(r[0] == r.want for r in spark.createDataFrame(rows, "t string, want string").select(L.valence("t"), "want").collect())

    def test_power(self, spark):
        rows = [("junior employee", "senior manager", "lower_to_higher"), ("department manager", "intern", "higher_to_lower"), ("colleague", "colleague", "peer")]
        df = spark.createDataFrame(rows, "a string, b string, want string")
        for v in L.ROLE_WORDS:
            assert all(r[0] == r.want for r in df.select(L.power_relation("a", "b", v), "want").collect())
        alone = spark.createDataFrame([("director", "colleague")], "a string, b string").select(*[L.power_relation("a", "b", v) for v in ("gold", "rsa")])
        assert tuple(one(alone)) == ("higher_to_lower", "peer")

    def test_mapping(self, spark):
        rows = [(" Joy ", "valid", "joy"), ("unknown", "retry", None), ("GUILT", "mapped", "sadness"), ("", "unknown", None), (None, "unknown", None), ("bliss", "unknown", None)]
        for r in spark.createDataFrame(rows, "x string, a string, m string").select("*", L.label_action("x").alias("ga"), L.mapped_label("x").alias("gm"), L.mapping_reason("x").alias("why")).collect():
            assert (r.ga, r.gm) == (r.a, r.m) and (r.why is not None) == (r.a == "mapped")

    def test_responses(self, spark):
        rows = [
            ('```json\n{"emotion": "joy", "valence": "0.5"}\n```', ("joy", "joy", 0.5, 0.0, 0.0, None)),
            ('text {"subtype": "deflection", "emotion": "fear", "valence": -1, "arousal": 1, "dominance": 0.25, "confidence": 0.9} more', ("deflection", "fear", -1.0, 1.0, 0.25, 0.9)),
            ('{"a": {"b": 1}}', ("unknown", "unknown", 0.0, 0.0, 0.0, None)),
            ('{"emotion": "joy", "valence": "high"}', ("unknown", "unknown", 0.0, 0.0, 0.0, None)),
            ("nothing", ("unknown", "unknown", 0.0, 0.0, 0.0, None)),
            (None, ("unknown", "unknown", 0.0, 0.0, 0.0, None)),
        ]
        got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", L.parsed_response("t").alias("r")).orderBy("i").collect()
        assert [tuple(g.r) for g in got] == [r[1] for r in rows]

    def test_paths_and_bands(self, spark):
        df = spark.createDataFrame([("a/b\\c", 5, None, "0123456789"), ("m", 6, "INT-2", None)], "m string, s int, i string, h string")
        assert [r[0] for r in df.select(L.cache_path("m", "s", "i", "h")).collect()] == ["a_b_c/scenario_5_01234567.json", "m/scenario_6_INT-2.json"]
        row = one(spark.range(1).select(L.effect_band(F.lit(-0.6)), L.effect_band(F.lit(0.147), "delta"), L.kappa_band(F.lit(0.8)), L.p_stars(F.lit(0.004)), L.listener_band(F.lit(0.72), F.lit(0.31)), L.v_band(F.lit(0.831), "bias"), L.ece_band(F.lit(0.1))))
        assert tuple(row) == ("medium", "small", "almost perfect", "**", "literal", "large", "moderately calibrated")
        assert one(spark.range(1).select(L.backoff(F.lit(10)), L.backoff(F.lit(1))))[:2] == (60.0, 4.0)


class TestAgreement:
    def test_cohen(self, spark):
        k = lambda rows: one(agreement.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b")).kappa
        assert k([(x, x) for x in ("joy", "fear", "anger", "trust")]) == 1.0
        assert k([("joy", "anger")] * 4) == 0.0
        assert k([("joy", "joy")] * 3) == 1.0
        assert k([]) == 0.0

    def test_simple_kappa_goldens(self, spark):
        rows = [("s", "full")] * 43 + [("s", "none")] * 257
        got = {r.overall: r.kappa for r in agreement.simple_kappa(spark.createDataFrame(rows, "s string, agreement string"), "s").collect()}
        assert math.isclose(got[1], 0.020952, abs_tol=1e-6)

    def test_fleiss_perfect_and_ties(self, spark):
        rows = [(i, r, "a") for i in range(3) for r in range(3)]
        df = spark.createDataFrame(rows, "subject int, rater int, cat string")
        assert one(agreement.fleiss_kappa(df)).kappa == 1.0
        tie = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 1, "")], "subject int, rater int, cat string")
        assert [tuple(r) for r in agreement.majority_vote(tie).collect()] == [(1, "a", 1)]

    def test_kappa_in_range(self, spark):
        rng = random.Random(0)
        for _ in range(5):
            rows = [(rng.choice("xyz"), rng.choice("xyz")) for _ in range(rng.randint(1, 30))]
            assert -1 <= one(agreement.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b")).kappa <= 1


class TestTests:
    def test_fit_golden(self, spark):
        df = spark.createDataFrame([(918, 2117 / 7), (1199, 6 * 2117 / 7)], "observed int, e double")
        r = one(hypothesis.with_p(hypothesis.chi2_fit(df, "observed", "e")))
        assert math.isclose(r.chi2, 1461.776177, abs_tol=1e-5) and math.isclose(r.v, 0.8309598, abs_tol=1e-6) and r.p_value < 1e-10

    def test_bias_golden(self, spark):
        rows = [("joy", "anger", 0, 918), ("joy", "fear", 0, 1199), ("anger", "joy", 0, 5), ("joy", "joy", 1, 7)]
        df = spark.createDataFrame(rows, "gold string, predicted string, correct int, n int").withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
        r = one(hypothesis.bias_test(df, "anger", 8))
        assert (r.total_wrong, r.n, r.hits) == (2122, 2117, 918) and math.isclose(r.chi2, 1461.776177, abs_tol=1e-5)
        assert one(hypothesis.bias_test(df.where("false"), "anger", 8)).error == "no misclassified rows"

    @pytest.mark.parametrize("b,c,want", [(10, 4, 1.785714), (3, 3, 0.166667), (0, 0, 0.0)])
    def test_mcnemar(self, spark, b, c, want):
        df = spark.createDataFrame([(1, 0)] * b + [(0, 1)] * c + [(1, 1)] * 5, "x int, y int")
        assert math.isclose(one(hypothesis.mcnemar(df, "x", "y")).chi2, want, abs_tol=1e-6)

    def test_contingency(self, spark):
        df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "a string, b string")
        r = one(hypothesis.chi2_contingency(df, "a", "b"))
        e = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
        want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((10, 20, 30, 5), e))
        assert r.df == 1 and math.isclose(r.chi2, want, rel_tol=1e-9)
        r = one(hypothesis.chi2_contingency(df.where("a = 'a'"), "a", "b"))
        assert (r.df, r.v) == (0, 0.0)

    def test_corrections(self, spark):
        df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.9)], "id int, p double")
        bh = {r.id: r.p_adjusted for r in hypothesis.benjamini_hochberg(df).collect()}
        assert [round(bh[i], 6) for i in (1, 3, 2, 4)] == [0.04, 0.053333, 0.053333, 0.9]
        assert {r.id: r.significant for r in hypothesis.bonferroni(df).collect()} == {1: True, 2: False, 3: False, 4: False}

    def test_benjamini_hochberg_in_ranges(self, spark):
        p = [((i * 37) % 50 + 1) / 60 for i in range(400)]
        df = spark.createDataFrame(list(enumerate(p)), "id int, p double").repartition(5)
        out = hypothesis.benjamini_hochberg(df)
        order, low, want = sorted(range(400), key=lambda i: (p[i], i)), 1.0, {}
        for rank in range(400, 0, -1):
            low = min(low, p[order[rank - 1]] * 400 / rank)
            want[order[rank - 1]] = (rank, round(low, 12))
        assert {r.id: (r.rank, round(r.p_adjusted, 12)) for r in out.collect()} == want
        # a frame that is open towards the end is computed anew for each row
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().replace(" ", "").replace("unboundedpreceding$(),unboundedfollowing$()", "").lower()

    def test_hash_bootstrap_at_size(self, spark):
        rows = [(g, i, float(i * i % 7)) for g, n in (("a", 40), ("b", 1), ("c", 25)) for i in range(n)] + [("d", i, None) for i in range(2)]
        df = spark.createDataFrame(rows, "g string, k int, v double").repartition(3)

        def picked(g, d):
            own = [v for h, _, v in rows if h == g]
            return [own[int(hashlib.md5(f"42|{d}|{i}".encode()).hexdigest()[:8], 16) % len(own)] for i in range(len(own))]

        for statistic, f in (("mean", np.mean), ("median", np.median), ("std", np.std)):
            boot = resampling.hash_bootstrap(df, "g", "v", "k", 6, statistic=statistic)
            got = {(r.g, r.draw): r.boot_mean for r in boot.collect()}
            assert len(got) == 24 and got["d", 0] is None
            assert all(math.isclose(x, f(picked(*at)), abs_tol=1e-9) for at, x in got.items() if at[0] != "d")
            assert "rightHint=(strategy=shuffle_hash)" in boot._jdf.queryExecution().optimizedPlan().toString()  # values of any number are not broadcast

    def test_metrics_read_the_rows_once(self, spark):
        rows = [(i % 3, i % 2, (i % 12) / 10.0 if i % 7 else None, i % 5 % 2) for i in range(300)]
        seen = spark.sparkContext.accumulator(0)

        def told(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = spark.createDataFrame([(("peer", "lower_to_higher", "higher_to_lower")[a], f"s{b}", c, k) for a, b, c, k in rows], "power_relation string, subtype string, confidence double, correct int")
        got = {r.metric: (r.value, r.n) for r in efficiency.all_metrics(df.mapInArrow(told, df.schema)).collect()}
        assert seen.value == 300
        ece, gap = one(efficiency.expected_calibration_error(df)), one(effects.power_gap(df))
        want = {"ece": (ece.ece, 300), "power_gap": (gap.gap, gap.n_a + gap.n_b), "power_gap_d": (gap.d, gap.n_a + gap.n_b), "efficiency_ratio": (one(efficiency.efficiency_ratio(df)).ratio, 300)}
        assert all(got[m][1] == n and math.isclose(got[m][0], v, abs_tol=1e-12) for m, (v, n) in want.items()) and len(got) == 14

    def test_counted_rows_stand_for_equal_ones(self, spark):
        df = spark.createDataFrame([("ab"[i % 2], float(i * i % 11)) for i in range(200)], "g string, v double")
        counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
        for st in splitting.STATISTICS:
            a, b = (splitting.relabelled(x, "g", "v", "a", "b", st, 30, n=n).collect()[0] for x, n in ((df, None), (counted, "n")))
            assert (a.n_a, a.n_b, a.p_value) == (b.n_a, b.n_b, b.p_value) and math.isclose(a.difference, b.difference, abs_tol=1e-9)
            a, b = (splitting.value_interval(x, ["g"], "v", st, 30, n=n).orderBy("g").collect() for x, n in ((df, None), (counted, "n")))
            assert all(math.isclose(x, y, abs_tol=1e-9) for r, s in zip(a, b) for x, y in zip(r[1:], s[1:]))

    def test_predictions_shuffle_lineitem_once(self, spark):
        plan = bindings.predictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # customers meet orders before lineitem does: their join lies deeper in the plan than lineitem's with orders
        depth = lambda part: next(len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if "Join" in x and part in x)
        assert depth("o_custkey") > depth("l_orderkey") and depth("l_suppkey") > depth("l_orderkey")

    def test_correlations(self, spark):
        df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (2.0, 5.0), (4.0, 1.0)], "x double, y double")
        r = one(hypothesis.with_correlation_p(hypothesis.correlations(df)))
        assert math.isclose(r.spearman, -0.3162278, abs_tol=1e-6) and 0 < r.spearman_p < 1
        assert one(hypothesis.correlations(df.limit(2))).pearson is None

    def test_permutation(self, spark):
        df = spark.createDataFrame([("a", 1)] * 40 + [("b", 0)] * 40 + [("c", 1)], "g string, v int")
        r = one(hypothesis.permutation_binary(df, "g", "v", "a", "b"))
        assert r.difference == 1.0 and r.p_value == 0.0

    def test_group_difference_needs_rows(self, spark):
        df = spark.createDataFrame([("a", 1), ("b", 0)], "g string, correct int")
        assert one(hypothesis.group_difference(df, "g")).chi is None


class TestEffects:
    def test_d(self, spark):
        rows = [("a", x) for x in (0.9, 0.92, 0.88, 0.91)] + [("b", x) for x in (0.1, 0.12, 0.08, 0.11)] + [("c", 1.0), ("d", 1.0)]
        df = spark.createDataFrame(rows, "g string, v double")
        assert one(effects.cohens_d(df, "g", "v", "a", "b")).d > 2
        assert one(effects.cohens_d_safe(df, "g", "v", "a", "a2")).d == 0.0
        assert one(effects.cohens_d_safe(df, "g", "v", "c", "d")).d == 0.0
        assert one(effects.cohens_d(df, "g", "v", "c", "d")).d is None

    def test_cliff(self, spark):
        rng = random.Random(1)
        a, b = [rng.randint(0, 20) for _ in range(60)], [rng.randint(3, 25) for _ in range(50)]
        df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v int")
        want = sum((x > y) - (x < y) for x in a for y in b) / (60 * 50)
        assert math.isclose(one(effects.cliffs_delta(df, "g", "v", "a", "b")).delta, want, abs_tol=1e-12)
        assert math.isclose(one(effects.cliffs_delta(df, "g", "v", "b", "a")).delta, -want, abs_tol=1e-12)

    def test_power_gap(self, spark):
        df = spark.createDataFrame([("peer", 1)] * 2 + [("lower_to_higher", 0)] * 2 + [("higher_to_lower", 0)], "power_relation string, correct int")
        assert one(effects.power_gap(df)).gap == 1.0


class TestMetrics:
    def test_efficiency(self, spark):
        df = spark.createDataFrame([(0,), (1,), (1,), (1,)], "correct int")
        r = one(efficiency.efficiency_ratio(df))
        assert r.model_accuracy == 0.75 and math.isclose(r.ratio, 0.75 / 0.82)
        assert one(efficiency.efficiency_ratio(df.where("false"))).n == 0

    def test_anchoring(self, spark):
        a = spark.createDataFrame([(1, "x"), (2, "y")], "key int, label string")
        b = spark.createDataFrame([(1, "y"), (2, "z")], "key int, label string")
        assert tuple(one(efficiency.anchoring(a, a)))[1:] == (0.0, 1.0)
        assert tuple(one(efficiency.anchoring(a, b)))[1:] == (1.0, 0.0)

    def test_calibration(self, spark):
        rows = [(1, 0.0), (0, 0.1), (1, 0.30000000000000004), (1, None), (0, 1.0)]
        df = spark.createDataFrame(rows, "correct int, confidence double")
        bins = {r.bin: r.n for r in efficiency.calibration(df).collect()}
        assert bins == {0: 1, 2: 1, 9: 2}
        r = one(efficiency.expected_calibration_error(df))
        assert r.n == 5 and math.isclose(r.ece, (0.1 + 0.7 + 1.0) / 5, abs_tol=1e-9)
        assert one(efficiency.expected_calibration_error(df.where("false"))).ece == 0.0

    def test_peak(self, spark):
        df = spark.createDataFrame([("m", 0, 0.5), ("m", 2, 0.9), ("m", 3, 0.9), ("m", 4, 0.1)], "model_id string, layer int, accuracy double")
        assert tuple(one(efficiency.relative_layers(df))) == ("m", 2, 0.9, 0.5)


class TestListeners:
    # utterance, (speaker, listener), literal label and value, pragmatic label and value
    GOLDEN = [
        ("great", ("a", "b"), "joy", 0.2951, "joy", 0.2951),
        ("hate", ("a", "b"), "sadness", 0.1978, "sadness", 0.1978),
        ("meeting", ("a", "b"), "trust", 0.1852, "trust", 0.1852),
        ("great", ("boss", "intern"), "joy", 0.2951, "joy", 0.2922),
        ("hate", ("boss", "intern"), "sadness", 0.1978, "disgust", 0.2204),
        ("meeting", ("boss", "intern"), "trust", 0.1852, "trust", 0.1799),
        ("great", ("intern", "boss"), "joy", 0.2951, "trust", 0.2733),
        ("hate", ("intern", "boss"), "sadness", 0.1978, "sadness", 0.2594),
        ("meeting", ("intern", "boss"), "trust", 0.1852, "trust", 0.2104),
    ]

    def test_golden(self, spark):
        rows = [(str(i), g[0], *g[1]) for i, g in enumerate(self.GOLDEN)]
        u = spark.createDataFrame(rows, "scenario_id string, utterance string, speaker_role string, listener_role string")
        names = {r.scenario_id: r for r in listeners.listener_labels(u).collect()}
        p = {}
        for r in listeners.pragmatic(u).collect():
            p[r.scenario_id, r.emotion] = (r.l0, r.l1)
        for i, g in enumerate(self.GOLDEN):
            r = names[str(i)]
            assert (r.l0_label, r.l1_label) == (g[2], g[4])
            assert round(p[str(i), g[2]][0], 4) == g[3] and round(p[str(i), g[4]][1], 4) == g[5]
            assert math.isclose(sum(p[str(i), e][1] for e in L.EMOTIONS), 1) and min(p[str(i), e][1] for e in L.EMOTIONS) >= 0

    def test_alignment(self, spark):
        u = spark.createDataFrame([("1", "great", "a", "b"), ("2", "hate", "a", "b")], "scenario_id string, utterance string, speaker_role string, listener_role string")
        r = one(listeners.alignment(spark.createDataFrame([("1", "joy"), ("2", None)], "scenario_id string, emotion string"), u))
        assert r.n == 2 and r.l0_agreement == 0.5


class TestResampling:
    def test_interval_holds_mean(self, spark):
        df = spark.createDataFrame([("a", x) for x in (1, 0, 1, 1, 0, 1, 1, 0)] + [("b", 1)], "g string, v int")
        for r in resampling.binary_bootstrap(df, ["g"], "v").collect():
            assert 0 <= r.ci_lower <= r.mean <= r.ci_upper <= 1
            assert r.g == "a" or (r.ci_lower, r.ci_upper) == (0.0, 1.0)
        df = spark.createDataFrame([("a", x) for x in (0.8, 0.85, 0.82, 0.78, 0.81) * 20], "g string, v double").withColumn("i", F.monotonically_increasing_id())
        r = one(resampling.numeric_bootstrap(df, ["g"], "v", 200))
        assert r.ci_lower <= 0.812 <= r.ci_upper

    def test_numeric_interval_whatever_the_order(self, spark):
        """Sorted, shuffled and repartitioned rows give one interval, as wide as the normal one; repeats count."""
        df = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") >= 10_000).cast("double").alias("v"))
        forms = [df, df.orderBy(F.rand(1)), df.repartition(3), df.coalesce(1)]
        got = [one(resampling.numeric_bootstrap(x, ["g"], "v", 500)) for x in forms]
        for r in got:
            assert math.isclose(r.ci_lower, got[0].ci_lower) and math.isclose(r.ci_upper, got[0].ci_upper)
        assert math.isclose(got[0].ci_upper - got[0].ci_lower, 2 * 1.96 * 0.5 / math.sqrt(20_000), rel_tol=0.15)
        many = spark.range(9000).select((F.col("id") % 7).alias("v"))
        r = one(resampling.numeric_bootstrap(many, [], "v", 500))
        assert math.isclose(r.ci_upper - r.ci_lower, 2 * 1.96 * 2.0 / math.sqrt(9000), rel_tol=0.15)
        groups = spark.range(3000).select((F.col("id") % 60).cast("string").alias("g"), (F.col("id") % 11).alias("v"))
        few = {r.g: r.ci_lower for r in resampling.numeric_bootstrap(groups, ["g"], "v", 50, held=4).collect()}
        assert few == {r.g: r.ci_lower for r in resampling.numeric_bootstrap(groups, ["g"], "v", 50).collect()} and len(few) == 60

    def test_relabelling_whatever_the_order(self, spark):
        df = spark.range(4000).select(F.when(F.col("id") < 2000, "a").otherwise("b").alias("g"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))
        same = [one(resampling.relabelled_means(x, "g", "v", "a", "b", 300)) for x in (df, df.repartition(3), df.orderBy("v"))]
        assert len({r.p_value for r in same}) == 1 and same[0].p_value > 0.05 and (same[0].n_a, same[0].n_b) == (2000, 2000)
        apart = df.withColumn("v", F.col("v") + F.when(F.col("g") == "a", 20).otherwise(0))
        assert one(resampling.relabelled_means(apart, "g", "v", "a", "b", 300)).p_value == 0

    def test_difference_and_pairs(self, spark):
        df = spark.createDataFrame([("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 10 + [("b", 0)] * 30, "g string, v int")
        r = one(resampling.difference_bootstrap(df, "g", "v", "a", "b"))
        assert r.difference == 0.5 and r.ci_lower < 0.5 < r.ci_upper and r.d > 1
        pairs = spark.createDataFrame([(0, 1)] * 20 + [(1, 1)] * 20, "x int, y int")
        r = one(resampling.paired_bootstrap(pairs, "x", "y"))
        assert r.difference == 0.5 and r.p_value < 0.01 and r.d > 0.9
        assert one(resampling.paired_bootstrap(pairs.where("false"), "x", "y")).n == 0

    @pytest.mark.parametrize("n,want", [(100, (2, 97)), (1000, (25, 975))])
    def test_index_form(self, spark, n, want):
        df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("boot_mean"))
        assert tuple(one(resampling.interval(df, "g")))[1:] == want


class TestComposition:
    def test_recombination(self, spark):
        s = spark.createDataFrame([(i, "abcde"[i % 5]) for i in range(100)], "id long, subtype string")
        rows = composition.stratified_recombinations(s).collect()
        assert len(rows) == 200 and all(r.source_subtype != r.context_subtype for r in rows)
        assert all("abcde"[r.utterance_id % 5] == r.source_subtype and "abcde"[r.context_id % 5] == r.context_subtype for r in rows)
        rows = composition.recombinations(s, 50).collect()
        assert len(rows) == 50 and all(r.source_subtype != r.context_subtype for r in rows)
        assert composition.recombinations(s.where("subtype = 'a'"), 50).count() == 0

    def test_score_guards(self, spark):
        df = spark.createDataFrame([("a", "b", 0, "x", "x", "y")], "source_subtype string, context_subtype string, original_correct int, predicted string, utterance_gold string, context_gold string")
        assert {r.score for r in composition.compositional(df).collect()} == {0.0}

    def test_prompts(self, spark):
        df = spark.createDataFrame([("1", "at work", "fine", "boss", None)], "scenario_id string, situation string, utterance string, speaker_role string, listener_role string")
        assert 'boss to : "fine"' in one(composition.rendered_prompts(df)).prompt
        assert composition.prompt_fanout(df).count() == 4
        with pytest.raises(ValueError):
            composition.rendered_prompts(df, "nothing")


class TestQuality:
    SCHEMA = "scenario_id string, model_id string, subtype string, emotion string, valence double, arousal double, dominance double, confidence double"

    def test_validate(self, spark):
        rows = [("1", "m", "deflection", "joy", 0.5, 0.5, 0.5, 0.5), ("2", "m", None, None, None, None, None, None), ("3", "m", "deflection", "Joy", float("nan"), -1.5, None, 1.5), ("4", "m", "", "", 1.0, -1.0, 0.0, None)]
        got = {}
        for r in quality.validate(spark.createDataFrame(rows, self.SCHEMA)).collect():
            got.setdefault(r.scenario_id, []).append((r.error_type, r.field))
        assert got == {
            "2": [("empty_response", None)],
            "3": [("schema_missing_field", "dominance"), ("invalid_emotion", "emotion"), ("vad_out_of_range", "valence"), ("vad_out_of_range", "arousal"), ("confidence_out_of_range", "confidence")],
        }
        r = one(quality.summary(spark.createDataFrame(rows, self.SCHEMA)))
        assert (r.total, r.invalid, r.error_rate, r.status) == (4, 2, 50.0, "FAILED")
        assert one(quality.summary(spark.createDataFrame([], self.SCHEMA))).status == "PASSED"

    def test_retry(self, spark):
        e = spark.createDataFrame([(str(i), "m", "empty_response" if i < 2 else "invalid_emotion", "high" if i < 2 else "medium") for i in range(30)], "scenario_id string, model_id string, error_type string, severity string")
        assert [(r.scenario_id, r.priority) for r in quality.retry_plan(e).orderBy("priority", "scenario_id").collect()] == [("0", 2), ("1", 2), ("10", 3)]
        items = spark.createDataFrame([("a",), ("b",), ("c",)], "model_id string")
        rates = spark.createDataFrame([("a", 0.5), ("b", 0.01)], "model_id string, rate double")
        names = lambda df: sorted(r.model_id for r in df.collect())
        assert names(quality.retry_filter(items, rates)) == ["a"]
        assert names(quality.retry_filter(items, rates, models=["b"])) == ["b"]
        assert names(quality.retry_filter(items, rates, all_invalid=True)) == ["a", "b", "c"]
        assert names(quality.retry_filter(items, rates, limit=0.9)) == ["a", "b", "c"]


class TestSplitting:
    """Trees of value counts against theory and literal resampling."""

    def test_keys_keep_the_order(self):
        v = np.array([-math.inf, -3.5, -1e-300, 0.0, 5e-324, 1.0, 1e300, math.inf])
        k = splitting._keys(v)
        assert (np.diff(k) > 0).all() and (splitting._values(k) == v).all()

    @pytest.mark.parametrize("leaf", [1024, 2])
    def test_the_data_itself(self, spark, leaf, monkeypatch):
        """Draw 0 gives each group's own statistic, in trees of any depth; nulls, negative, equal and single values."""
        monkeypatch.setattr(splitting, "LEAF", leaf)
        rng = random.Random(1)
        rows = [(rng.choice(["a", "b", None]), rng.choice([None, -1.5, 0.0, -0.0, 2.25, rng.gauss(0, 1)])) for _ in range(400)] + [("one", 7.0), ("none", None)]
        df = spark.createDataFrame(rows, "g string, v double").repartition(3)
        by = defaultdict(list)
        for g, v in rows:
            if v is not None:
                by[g].append(v)
        for name, f in (("mean", np.mean), ("std", np.std), ("median", np.median)):
            boot = splitting.resampled(df, ["g"], "v", name, 20)
            got = {r.g: r.boot_mean for r in boot.where("draw = 0").collect()}
            assert set(got) == set(by) and all(math.isclose(got[g], f(x), abs_tol=1e-9) for g, x in by.items())
            if name != "median":
                continue
            again = sorted((str(r.g), r.draw, round(r.boot_mean, 9)) for r in splitting.resampled(df.orderBy("v").repartition(5), ["g"], "v", name, 20).collect())
            assert again == sorted((str(r.g), r.draw, round(r.boot_mean, 9)) for r in boot.collect()) and len(again) == 21 * len(by)

    def test_widths_of_a_million_rows(self, spark):
        n = 1_000_000
        df = spark.range(n).select(((F.col("id") * 7919 % n + 0.5) / n).alias("v"))
        for name, error in (("mean", math.sqrt(1 / 12 / n)), ("median", 0.5 / math.sqrt(n)), ("std", math.sqrt((1 / 80 - 1 / 144) / (4 / 12) / n))):
            if name != "median":  # sums meet every value: fewer values, each a thousand times
                df = spark.range(n).select(((F.col("id") % 1000 + 0.5) / 1000).alias("v"))
            if name == "median":
                df = spark.range(n).select(((F.col("id") * 7919 % n + 0.5) / n).alias("v"))
            r = one(splitting.value_interval(df, [], "v", name, 800))
            assert math.isclose(r.ci_upper - r.ci_lower, 2 * 1.96 * error, rel_tol=0.15) and r.ci_lower < r.estimate < r.ci_upper

    @pytest.mark.parametrize("statistic", ["mean", "median", "std"])
    def test_relabelling_against_literal_shuffles(self, spark, statistic):
        rng = np.random.default_rng(5)
        a, b = np.round(rng.normal(0.35, 1, 60), 1), np.round(rng.normal(0, 1.3, 45), 1)
        f = {"mean": np.mean, "median": np.median, "std": np.std}[statistic]
        both, seen = np.r_[a, b], f(a) - f(b)
        hits = 0
        for _ in range(4000):
            x = rng.permutation(both)
            hits += abs(f(x[:60]) - f(x[60:])) >= abs(seen) - 1e-12
        df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 9.0), ("a", None)], "g string, v double")
        r = one(splitting.relabelled(df, "g", "v", "a", "b", statistic, 2000))
        assert (r.n_a, r.n_b) == (60, 45) and math.isclose(r.difference, seen, abs_tol=1e-9)
        p = hits / 4000
        assert abs(r.p_value - p) < 4 * math.sqrt(max(p * (1 - p), 0.002) * (1 / 2000 + 1 / 4000))
        empty = one(splitting.relabelled(df, "g", "v", "a", "nobody", statistic, 10))
        assert (empty.n_a, empty.n_b, empty.difference, empty.p_value) == (60, 0, None, None)

    def test_large_counts_by_their_limit(self):
        x = splitting._half(np.random.default_rng(1), np.full(4000, 3 * 10**9), 4 * 10**9, 6 * 10**9, False)
        spread = math.sqrt(3e9 * 0.4 * 0.6 * 7 / 10)
        assert abs(x.mean() - 1.2e9) < 5 * spread / math.sqrt(4000) and math.isclose(x.std(), spread, rel_tol=0.1)

    def test_no_row_is_copied(self, spark):
        """Nothing between the rows and their counts but one aggregation."""
        df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
        plan = splitting.value_counts(df, F.struct("g"), "v", F.lit(True))._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan and "Generate" not in plan and "Window" not in plan and "Join" not in plan


class TestWork:
    def test_breaker(self, spark):
        rows = [("m", i, int(i in (2, 3, 4, 8, 9))) for i in range(12)] + [("n", 0, 0)]
        got = {r.model_id: (r.longest, r.dropped, r.dropped_at) for r in worklist.circuit_breaker(spark.createDataFrame(rows, "model_id string, seq int, failed int"), 3).collect()}
        assert got == {"m": (3, True, 4), "n": (0, False, None)}

    @pytest.mark.parametrize("parts", [1, 3, 16])
    def test_runs_join_up_across_ranges(self, spark, parts):
        """Long runs over many ranges, one key with nearly all rows, null keys, flags and orders, equal orders."""
        rng = random.Random(parts)
        rows = [("hot", i, int(rng.random() < 0.9 or 300 < i < 700)) for i in range(1500)] + [("all", i, 1) for i in range(200)] + [("none", i, 0) for i in range(5)]
        rows += [(None, i, rng.choice([0, 1, None])) for i in range(30)] + [("tied", 7, f) for f in (1, 0, 1, 1)] + [("tied", None, 1)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, o int, f int").repartition(5)
        by = defaultdict(list)
        for r in rows:
            by[r[0]].append(r)
        runs, places = [], []
        for k, x in by.items():
            run = 0
            for i, (_, o, f) in enumerate(sorted(x, key=lambda r: (r[1] is not None, r[1] or 0, bool(r[2])))):
                run = run + 1 if f else 0
                runs.append((str(k), str(o), str(f), run))
                places.append((str(k), str(o), i + 1))
        got = [(str(r.k), str(r.o), str(r.f), r.run) for r in sequence.runs(df, "k", "o", "f", parts).collect()]
        assert sorted((k, o, f == "1", n) for k, o, f, n in got) == sorted((k, o, f == "1", n) for k, o, f, n in runs)
        got = [(str(r.k), str(r.o), r.position) for r in sequence.numbered(df, "k", "o", ("f",), parts).collect()]
        assert sorted(got) == sorted(places)

    def test_no_window_over_all_calls_of_a_model(self, spark):
        calls = spark.createDataFrame([("m", i, i % 2) for i in range(40)], "model_id string, seq int, failed int")
        for df in (worklist.circuit_breaker(calls, 2), worklist.milestones(calls, 100)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            windows = [line for line in plan.split("\n") if "Window [" in line]
            assert windows and all("__p#" in line for line in windows)

    def test_zip(self, spark):
        a = spark.createDataFrame([(i, f"a{i}") for i in range(0, 50, 2)], "x int, n string").repartition(4)
        b = spark.createDataFrame([(i, f"b{i}") for i in range(20)], "y int, m string").repartition(3)
        got = sorted((r.position, r.n, r.m) for r in accuracy.zip_join(a, b, ["x"], ["y"]).collect())
        assert got == [(i + 1, f"a{2 * i}", f"b{i}") for i in range(20)]

    def test_cache(self, spark):
        k = "model_id string, scenario_id int, intervention string, prompt_hash string"
        work = spark.createDataFrame([("m", 1, None, "h"), ("m", 2, "i", None), ("m", 3, None, None)], k)
        cache = spark.createDataFrame([("m", 1, None, "h", "r1"), ("m", 2, None, None, "r2")], k + ", response string")
        probed = worklist.probe(work, cache)
        assert sorted((r.scenario_id, r.hit, r.response) for r in probed.collect()) == [(1, True, "r1"), (2, False, None), (3, False, None)]
        s = one(worklist.cache_stats(probed))
        assert (s.hits, s.misses, round(s.saved_percent, 4)) == (1, 2, 33.3333)

    def test_calls_under_limits(self, spark, tmp_path):
        """Calls at once by provider, retries with pauses, kept errors, and a circuit that opens."""
        log = str(tmp_path)

        def call(row):
            began = time.time()
            if row["id"] % 10 == 3 and not os.path.exists(f"{log}/seen-{row['id']}"):
                open(f"{log}/seen-{row['id']}", "w").close()
                raise TimeoutError("once")
            if row["id"] % 10 == 7:
                raise ValueError("never")
            time.sleep(0.02)
            with open(f"{log}/call-{row['id']}", "w") as f:
                f.write(f"{row['provider']} {began} {time.time()}")
            return f"r{row['id']}"

        df = spark.range(60).select("id", F.when(F.col("id") % 3 == 0, "one").when(F.col("id") % 3 == 1, "two").alias("provider")).repartition(4)
        got = {r.id: r for r in worklist.call_limited(df, call, {"one": 1, "two": 2}, sleep=lambda s: None).collect()}
        assert len(got) == 60
        for i, r in got.items():
            want = (None, 3, "ValueError: never") if i % 10 == 7 else (f"r{i}", 2 if i % 10 == 3 else 1, None)
            assert (r.response, r.attempts, r.error) == want and (r.waited > 0) == (r.attempts > 1)
            if r.attempts == 3:
                assert 0.75 * 2 + 0.75 * 4 <= r.waited <= 1.25 * 2 + 1.25 * 4
        spans = defaultdict(list)
        for f in tmp_path.glob("call-*"):
            who, a, b = f.read_text().split()
            spans[who].append((float(a), float(b)))
        for who, most in (("one", 1), ("two", 2), ("None", 1)):
            assert spans[who] and max(sum(a <= t < b for a, b in spans[who]) for t, _ in spans[who]) <= most
        broken = worklist.call_limited(spark.range(20).select("id", F.lit("x").alias("provider")), lambda row: 1 / 0, {"x": 1}, tries=2, give_up=5, sleep=lambda s: None).collect()
        assert sorted((r.error, r.attempts) for r in broken) == [("ZeroDivisionError: division by zero", 2)] * 5 + [("circuit open", 0)] * 15
        assert worklist.call_limited(df.where("false"), call).count() == 0

    def test_predict_hook(self, spark):
        df = spark.createDataFrame([("p", "openai", "x")], "id string, provider string, prompt string")

        def model(frames):
            for f in frames:
                yield f.assign(emotion="joy")[["id", "emotion"]]

        assert [tuple(r) for r in worklist.predict(df, model, "id string, emotion string").collect()] == [("p", "joy")]


def test_views_have_the_documented_columns(spark):
    d = "/root/testdata/sf0.001"
    assert bindings.predictions(spark, d).columns == ["model_id", "scenario_id", "predicted", "gold", "subtype", "power_relation", "confidence", "latency_ms", "correct"]
    assert bindings.ratings(spark, d).groupBy("subject").count().select("count").distinct().collect()[0][0] == 3
