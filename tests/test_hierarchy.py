"""Two-level breakdowns: dependencies between columns, the worked example of ethnic groups, and its edge cases."""

import pytest
from pyspark.sql import functions as F

from statwitness.operators import extract as E, hierarchy as H

GROUPS = [("Asian / Asian British", "Chinese"), ("Asian / Asian British", "Indian"), ("White", "White British"), ("White", "Gypsy")]
CHECK = {"Chinese": ["98", "98", "98", "98"], "Indian": ["97", "97", "97", "97"], "White British": ["95", "95", "96", "96"], "Gypsy": ["c", "z", "80", "81"]}
SCORE = {"Chinese": ["23.5", "23.8", "24.1", "24.3"], "Indian": ["22.7", "23.0", "23.3", "23.5"], "White British": ["19.2", "19.5", "19.8", "20.0"], "Gypsy": ["15.0", "x", "15.1", "15.2"]}
YEARS = ["202122", "202223", "202324", "202425"]
LABELS = [("mtc_score_average", "Average attainment score"), ("completed_check_pupil_percent", "Percentage of eligible pupils who took the check")]
FILTERS = ["ethnicity_major", "ethnicity_minor", "geographic_level", "sex", "time_period"]


def table(spark):
    rows = []
    for y, year in enumerate(YEARS):
        for sex in ("Boys", "Girls", "Total"):
            for major, minor in GROUPS:
                values = (CHECK[minor][y], SCORE[minor][y]) if sex == "Total" else ("1", "1")
                rows.append((year, sex, "National", major, minor, *values))
            rows += [(year, sex, "National", m, "Total", "2", "2") for m in ("White", "Asian / Asian British")]
            rows += [(year, sex, g, "Total", "Total", "3", "3") for g in ("National", "Regional")]
    names = ["time_period", "sex", "geographic_level", "ethnicity_major", "ethnicity_minor", "completed_check_pupil_percent", "mtc_score_average"]
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"_{i + 1}"))]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)]).select(F.lit("mtc").alias("table_id"), F.col("_8").cast("string").alias("row_no"), F.create_map(*pairs).alias("values"))


def parts(spark):
    data = table(spark)
    pairs = H.column_pairs(data, spark.createDataFrame([("mtc", FILTERS)], "table_id string, columns array<string>"))
    return data, pairs, H.column_dependencies(pairs)


def chosen(spark, texts):
    data, pairs, dependencies = parts(spark)
    heads = spark.createDataFrame([(f"h{i}", "mtc", t) for i, t in enumerate(texts)], "headline_id string, table_id string, paragraph string")
    values = pairs.select("table_id", F.col("minor").alias("column_name"), F.col("minor_value").alias("value")).distinct()
    names = H.name_mentions(heads, H.hierarchies(dependencies))
    return data, heads, H.choose_breakdowns(E.match_filter_values(heads, values), names, dependencies, pairs)


def test_dependencies(spark):
    _, _, dependencies = parts(spark)
    got = {(r.minor, r.major): (r.n_minor, r.n_major) for r in dependencies.collect()}
    # the one level that is no whole goes with every sex and year
    assert got == {("ethnicity_minor", "ethnicity_major"): (4, 2), ("sex", "geographic_level"): (2, 1), ("time_period", "geographic_level"): (4, 1)}
    assert [(r.minor, r.major) for r in H.hierarchies(dependencies).collect()] == [("ethnicity_minor", "ethnicity_major")]


def test_worked_example_of_two_levels(spark):
    text = "The average score and the share of pupils who took the check differ by ethnicity."
    data, heads, breakdowns = chosen(spark, [text])
    phrases = spark.createDataFrame([("average score", "mtc_score_average"), ("took the check", "completed_check_pupil_percent")], "phrase string, metric string")
    columns = spark.createDataFrame([("mtc", m) for m, _ in LABELS], "table_id string, column_name string")
    aggregates = spark.createDataFrame([("mtc", c, v) for c, v in (("sex", "Total"), ("geographic_level", "National"), ("ethnicity_major", "Total"), ("ethnicity_minor", "Total"))],
                                       "table_id string, column_name string, aggregate_value string")
    specs = E.build_specs(heads, E.match_metrics(heads, phrases, columns), breakdowns, aggregates)
    out = E.extract_tables(specs, data, spark.createDataFrame(LABELS, "metric string, label string"), "time_period").orderBy("metric", "time_value").collect()
    assert [(r.label, r.time_value) for r in out] == [(LABELS[1][1] if i == 0 else LABELS[0][1] if i == 4 else "", YEARS[i % 4]) for i in range(8)]
    shown = lambda v: v if v in "czx" else f"{v}%"
    for i, r in enumerate(out):
        for major, minor in GROUPS:
            want = shown(CHECK[minor][i]) if i < 4 else E_plain(SCORE[minor][i - 4])
            assert r.cells[f"{major} / {minor}"] == want
        assert len(r.cells) == 4


def E_plain(v):
    return v[:-2] if v.endswith(".0") else v


@pytest.mark.parametrize("text, columns, keys", [
    ("Chinese pupils in the White group", ["ethnicity_major", "ethnicity_minor"], [["Asian / Asian British", "Chinese"], ["White", "Gypsy"], ["White", "White British"]]),
    ("White pupils, above all White British ones", ["ethnicity_major", "ethnicity_minor"], [["White", "White British"]]),
    ("Boys and girls among White pupils", ["sex"], [["Boys"], ["Girls"]]),
    ("Chinese and Indian pupils", ["ethnicity_minor"], [["Chinese"], ["Indian"]]),
    ("Chinese and Indian pupils by ethnicity", ["ethnicity_major", "ethnicity_minor"], [["Asian / Asian British", "Chinese"], ["Asian / Asian British", "Indian"]]),
    ("Gypsy pupils", None, None), ("Total and all", None, None), ("", None, None)])
def test_choice(spark, text, columns, keys):
    got = chosen(spark, [text])[2].collect()
    assert [(r.columns, r["keys"]) for r in got] == ([] if columns is None else [(columns, keys)])


def test_all_null_columns_are_dropped(spark):
    long = spark.createDataFrame([("m", "1", "A", "x", 1), ("m", "1", "B", None, 2), ("m", "2", "A", None, 3)], "metric string, t string, c string, value string, n int")
    wide = E.pivot_first(long, ["metric", "t"], "c", ["A", "B", "C"], ["n"])
    assert wide.columns == ["metric", "t", "A"] and [tuple(r) for r in wide.collect()] == [("m", "1", "x")]
