from modelsift.operators import profile, rules


def found(profile_rows, rule_rows):
    rows = rules.violations(profile_rows, rule_rows).collect()
    return sorted((r["Rule Name"], r["Object Name"]) for r in rows)


def columns(spark):
    rows = [(i, i * 2, f"text {i % 3}", None if i % 2 else "x") for i in range(100)]
    df = spark.createDataFrame(rows, "k bigint, twice bigint, t string, half string")
    return profile.column_profile({"tab": df}, "m")


def test_a_new_row_is_a_new_rule(spark):
    cols = columns(spark)
    assert found(cols, rules.rule_table(spark)) == []
    new = ("Half empty", "C", "Info", "D", [rules.number("null_count", ">=", factor=0.5, other="row_count")])
    assert found(cols, rules.rule_table(spark, [*rules.STARTER_RULES, new])) == [("Half empty", "half")]
    assert set(found(cols, rules.rule_table(spark, [new, new]))) == {("Half empty", "half")}
    assert len(found(cols, rules.rule_table(spark, [new, new]))) == 1


def test_every_comparison(spark):
    cols = columns(spark)
    held = {}
    for sign in rules.COMPARISONS:
        rule = (sign, "C", "Info", "D", [rules.number("cardinality", sign, factor=0.03, other="row_count")])
        held[sign] = [c for _, c in found(cols, rules.rule_table(spark, [rule]))]
    assert held == {
        "=": ["t"], "<>": ["half", "k", "twice"], "<": ["half"], "<=": ["half", "t"], ">": ["k", "twice"], ">=": ["k", "t", "twice"],
    }
    texts = [("T", "C", "Info", "D", [rules.text("data_type", "<>", "string"), rules.number("null_count", "=", 0)])]
    assert found(cols, rules.rule_table(spark, texts)) == [("T", "k"), ("T", "twice")]


def test_conditions_that_cannot_hold(spark):
    cols = columns(spark)
    odd = [
        ("no such measure", "C", "I", "D", [rules.number("sortedness", "=", 1)]),
        ("one known, one not", "C", "I", "D", [rules.number("row_count", ">", 0), rules.number("sortedness", ">", 0)]),
        ("no such other", "C", "I", "D", [rules.number("row_count", ">", factor=1, other="sortedness")]),
        ("null measure", "C", "I", "D", [rules.number("hierarchy_size_bytes", ">=", 0)]),
        ("no such sign", "C", "I", "D", [rules.number("row_count", "~", 0)]),
        ("nothing asked", "C", "I", "D", []),
        ("null conditions", "C", "I", "D", None),
        (None, None, None, None, [rules.number("row_count", ">", 0)]),
    ]
    rows = rules.violations(cols, rules.rule_table(spark, odd)).collect()
    assert [r["Rule Name"] for r in rows] == [None] * 4
    assert rules.violations(cols, rules.rule_table(spark, [])).count() == 0
    assert rules.violations(cols.filter("false"), rules.rule_table(spark)).count() == 0
