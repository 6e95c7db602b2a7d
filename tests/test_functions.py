"""Column expressions on small literal frames, one row per edge case."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakesight.functions import cleaning, formats, loglines, messages, places, questions as Q, resources, text, vectors
from lakesight.operators import events


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, rows, schema, column):
    return [r[0] for r in values(spark, rows, schema, column)]


def test_defaults_of_the_two_paths(spark):
    row = [(None, "", None, None, "", None)]
    schema = "customer_id string, brand string, store_name string, price decimal(18,2), customer_feedback string, feedback_sentiment_category string"
    df = spark.createDataFrame(row, schema)
    assert tuple(cleaning.batch_defaults(df).first()) == ("", "Unknown", "Unknown", Decimal("0.00"), "", "Neutral")
    assert tuple(cleaning.embed_defaults(df).first()) == ("", "", None, None, "", "")


def test_missing_columns_are_added_without_regard_to_case(spark):
    df = cleaning.add_missing_columns(spark.createDataFrame([("LG",)], "BRAND string"))
    assert df.columns == ["BRAND", "price", "store_name", "feedback_sentiment_category", "fridge_model"]


@pytest.mark.parametrize("token", cleaning.NA_TOKENS)
def test_missing_tokens(spark, token):
    assert one(spark, [(token,)], "v string", cleaning.na_to_null(F.col("v"))) == [None]


def test_safe_int(spark):
    got = one(spark, [("4",), ("4.0",), (" 4 ",), ("x",), (None,)], "v string", cleaning.safe_int(F.col("v")))
    assert got == [4, None, 4, None, None]
    assert one(spark, [(4.7,), (-4.7,)], "v double", cleaning.safe_int(F.col("v"))) == [4, -4]


def test_literal_values(spark):
    assert one(spark, [("NaN",), ("",), ("a",)], "v string", cleaning.sql_literal_value(F.col("v"))) == [None, None, "a"]
    numbers = [(float("nan"),), (float("inf"),), (float("-inf"),), (2.5,)]
    assert one(spark, numbers, "v double", cleaning.sql_literal_value(F.col("v"), is_text=False)) == [None, None, None, 2.5]


def test_union_field(spark):
    schema = "f struct<is_null:boolean,string_value:string,long_value:long,double_value:double,boolean_value:boolean>"
    rows = [((None, "a", 1, None, None),), ((False, None, 7, None, None),), ((None, None, None, None, True),), ((True, "a", None, None, None),)]
    assert one(spark, rows, schema, cleaning.union_field(F.col("f"))) == ["a", "7", "true", None]


def test_percentage_rounds_half_up(spark):
    rows = [(1, 8), (1, 3), (0, 5), (1, 0)]
    got = one(spark, rows, "a int, b int", formats.percentage(F.col("a"), F.col("b")))
    assert got == [Decimal("12.50"), Decimal("33.33"), Decimal("0.00"), None]


def test_iso_time_without_an_empty_fraction(spark):
    rows = [(dt.datetime(2026, 1, 2, 3, 4, 5, 60),), (dt.datetime(2026, 1, 2, 3, 4, 5),)]
    assert one(spark, rows, "t timestamp_ntz", formats.iso_utc(F.col("t"))) == ["2026-01-02T03:04:05.000060Z", "2026-01-02T03:04:05Z"]


def test_relative_age(spark):
    now = dt.datetime(2026, 1, 10, 12, 0)
    minutes = [0, 1, 59, 60, 119, 120, 1439, 1440, 2880, -5]
    rows = [(now - dt.timedelta(minutes=m),) for m in minutes]
    got = one(spark, rows, "t timestamp_ntz", formats.relative_age(F.col("t"), F.lit(now).cast("timestamp_ntz")))
    assert got == [
        "Just now", "1 minute ago", "59 minutes ago", "1 hour ago", "1 hour ago", "2 hours ago", "23 hours ago",
        "1 day ago", "2 days ago", "Just now",
    ]


def test_whole_dollars(spark):
    rows = [(Decimal("1234.50"),), (Decimal("-0.50"),), (Decimal("2.49"),), (Decimal("0.00"),)]
    assert one(spark, rows, "v decimal(18,2)", formats.whole_dollars(F.col("v"))) == ["$1,235", "-$1", "$2", "$0"]


def test_interval_minutes(spark):
    assert one(spark, [(0,), (59,), (300,)], "v int", formats.interval_minutes(F.col("v"))) == [1, 1, 5]


def test_regions(spark):
    rows = [("1 A St, Boston, MA",), ("Detroit",), ("San Francisco, CA",), ("Miami",), ("Reno",), ("New York and Chicago",)]
    got = one(spark, rows, "a string", places.sales_region(F.col("a")))
    assert got == ["Northeast", "Midwest", "West", "South", "Other", "Northeast"]


def test_stack_scopes(spark):
    rows = [("x/nonkube",), ("x/kube",), ("x/shared_nondurable",), ("shared/nonkube/y",), ("plain",)]
    assert one(spark, rows, "p string", places.stack_scope(F.col("p"))) == ["nonkube", "kube", "shared-nondurable", "y", "plain"]


def test_question_rules(spark):
    rows = [("how many complaints",), ("why are customers unhappy",), ("hello",), ("DISCOUNT",), ("",), (" \n ",), ("x" * 1000,), ("x" * 1001,), ("a; drop b",)]
    got = values(spark, rows, "q string", Q.is_qualitative(F.col("q")), Q.question_error(F.col("q")), Q.question_is_risky(F.col("q")))
    assert [g[0] for g in got[:4]] == [False, True, True, False]
    assert [g[1] for g in got[4:8]] == ["Query cannot be empty"] * 2 + [None, "Query too long (max 1000 characters)"]
    assert got[8][1:] == (None, True)


def test_search_text(spark):
    rows = [(None,), ("",), (" ab ",), ("abc",)]
    got = one(spark, rows, "q string", Q.search_text_error(F.col("q")))
    assert got == ["query_text is required"] * 2 + ["query_text must be at least 3 characters", None]


def test_sql_extraction(spark):
    rows = [("```sql\nSELECT 1;\n```",), ("So: select a\nfrom b; done;",), ("  no statement  ",), ("```\nSELECT 2\n```",)]
    assert one(spark, rows, "r string", Q.extract_sql(F.col("r"))) == ["SELECT 1;", "select a\nfrom b;", "no statement", "SELECT 2"]


def test_tool_calls(spark):
    reply = 'TOOL: Generate_SQL\nINPUT: {"question": "q"}\ntool: semantic_search\nINPUT: {query_text: \'bad\', limit: 7}\nTOOL: execute_sql'
    calls = one(spark, [(reply,)], "r string", Q.tool_calls(F.col("r")))[0]
    assert [c["tool"] for c in calls] == ["generate_sql", "semantic_search", "execute_sql"]
    assert calls[0]["input"] == '{"question": "q"}'
    assert '"query_text":"bad"' in calls[1]["input"] and '"limit":"7"' in calls[1]["input"]
    assert calls[2]["input"] == "{}"


def test_answer_signs(spark):
    rows = [("only 7",), ("12",), ("1.5",), ("<execute_sql> x",), ("Based on the Information",)]
    got = values(spark, rows, "a string", Q.answer_has_number(F.col("a")), Q.answer_has_tool_tag(F.col("a")), Q.answer_claims_data(F.col("a")))
    assert got == [(False, False, False), (True, False, False), (True, False, False), (False, True, False), (False, False, True)]


def test_fatal_errors(spark):
    rows = [("not_found_error model: x 404",), ("overloaded_error not_found_error",), ("Model: m 404",), ("invalid_api_key",),
            ("authentication has failed",), ('{"type" : "error"}',), ("{'type': 'error'}",), ("other",), ("",), (None,)]
    got = one(spark, rows, "m string", Q.error_is_fatal(F.col("m")))
    assert got == [True, False, True, True, True, True, True, False, False, False]


def test_error_keys(spark):
    rows = [("timeout: 5s: x",), ("y" * 150,), (":",)]
    assert one(spark, rows, "m string", Q.error_key(F.col("m"))) == ["timeout", "y" * 100, ""]


def test_truncate(spark):
    cases = {0: "abcdefghij", 5: "ab...", 10: "abcdefghij", 3: "...", 2: "abcdefghi..."}
    for limit, expected in cases.items():
        assert one(spark, [("abcdefghij",)], "s string", text.truncate(F.col("s"), limit)) == [expected]


def test_log_times(spark):
    rows = [("[2026-01-02 03:04:05.678901 UTC] x",), ("[2026-01-02  03:04:05.5] x",), ("no time",), ("[2026-02-30 00:00:00.1 UTC]",)]
    got = one(spark, rows, "line string", loglines.line_timestamp(F.col("line")))
    assert got == [dt.datetime(2026, 1, 2, 3, 4, 5, 678901), dt.datetime(2026, 1, 2, 3, 4, 5, 500000), None, None]
    assert one(spark, [("RAW_COUNT=200 x",), ("y",)], "l string", loglines.announced_count(F.col("l"), "RAW")) == [200, None]


def test_message_bodies(spark):
    schema = "kind string, context string, parts array<struct<kind:string,text:string>>, attachments array<struct<name:string>>"
    image = ("image_asset_pointer", None)
    rows = [
        ("text", None, [("string", "a "), ("string", "  "), image, image, ("object", " b ")], [("one.png",)]),
        ("model_editable_context", "  memo ", None, None),
        ("text", None, [("string", " ")], None),
        ("text", None, None, None),
        ("text", None, [("object", "x"), image, image], [("",), ("two.png",)]),
    ]
    body = messages.body_text(F.col("kind"), F.col("context"), F.col("parts"), F.col("attachments"))
    assert one(spark, rows, schema, body) == [
        "a \n[image: one.png]\n[image]\nb", "memo", None, None, "x\n[image]\n[image: two.png]",
    ]


def test_vector_texts(spark):
    rows = [([0.5, -1.25],), ([],)]
    c = F.col("v").cast("array<float>")
    assert one(spark, rows, "v array<double>", vectors.to_text(c)) == ["[0.5,-1.25]", "[]"]
    assert one(spark, [("[0.5,-1.25]",)], "t string", vectors.from_text(F.col("t"))) == [[0.5, -1.25]]


BODIES = {
    'event: complete\ndata: {"answer": "hello"}\n\n': ("hello", None),
    'event: error\ndata: {"message": "boom"}\n\n': (None, "boom"),
    'event: complete\ndata: {"answer": "a"}\n\nevent: complete\ndata: {"answer": "b"}\n\n': ("b", None),
    'event: complete\ndata: {"answer": "a"}\n\nevent: complete\ndata: {"iterations": 1}\n\n': ("a", None),
    'event: complete\ndata: {"answer": "a"}\ndata: {broken\n\n': ("a", None),
    'event: complete\ndata: {"answer": "a"}\n\nevent: complete\ndata: {"answer": null}\n\n': (None, None),
    "event: question\ndata: {}\n\n": (None, None),
    "": (None, None),
}


def test_event_texts(spark):
    df = events.parse_bodies(spark.createDataFrame([(b,) for b in BODIES], "body string"))
    assert [(r["answer"], r["error_message"]) for r in df.collect()] == list(BODIES.values())


def test_builtin_names(spark):
    rows = [("vpc:default (10.0.0.0/16) [x]",), ("iam:AWSServiceRoleFor",), ("s3:acme-data",), ("cdk-assets",), ("x:my-default",)]
    assert one(spark, rows, "d string", resources.is_builtin(F.col("d"))) == [True, True, False, True, False]


def test_inputs_under_the_names_of_their_tools(spark):
    rows = [
        ("semantic_search", '{"query": "a", "question": "b", "brand": "x", "id": "1"}'), ("semantic_search", '{"filters": "no", "brand": ["x", "y"]}'),
        ("execute_sql", '{"query": "q", "sql": "s"}'), ("generate_sql", '{"query": "q"}'), ("other", '{"query": "q"}'), ("semantic_search", "{}"),
    ]
    got = one(spark, rows, "t string, i string", Q.normalized_input(F.col("t"), F.col("i"), F.lit("asked"), ["brand", "store_name"]))
    assert [tuple(g) for g in got] == [
        ("b", None, None, {"brand": ["x"]}), ("asked", None, None, {"brand": ["x", "y"]}), (None, "s", None, None),
        (None, None, "q", None), (None, None, None, None), ("asked", None, None, None),
    ]


def test_every_shape_of_a_name_decides_for_some_name(spark):
    naming = resources.Naming(prefix="shop", env="prod", eks="k8", state="keep")
    one_of_a_kind = {
        "security_group": ["shop-x", "k8s-shopkube-shopapisv-x", "k8s-traffic-shopk8produseast1-x"],
        "alb": ["shop-a-prod", "x-shop-prod-y", "k8s-shopkube-shopapisv-x", "k8s-traffic-shopk8produseast1-x"],
        "ecr": ["shop-a-prod", "x-shop-prod"],
        "ecs_cluster": ["shop-a-prod"], "eks_cluster": ["shop-a-prod"],
        "target_group": ["shop-a-prod", "x-shop-prod-y", "k8s-shopkube-shopapisv-x", "k8s-traffic-shopk8produseast1-x"],
        "eventbridge_rule": ["shop-prod"], "rds_cluster": ["shop-prod"], "vpc": ["shop-prod"],
        "iam_role": ["shop-prod", "shop-eks-x", "shop-k8-prod", "eksctl-shop-k8-prod", "eks-ebs-csi-driver-role"],
        "ebs_volume": ["x-shop-prod", "x-shop-k8-prod-us-east-1"],
        "s3": ["shop-prod-x", "x-shop-prod-y", "shop-tf-x", "shop-keep", "shopx-prod-delta-internal-y", "shopx-prod-artifacts-internal-y",
               "shopx-prod-frontend-y", "shopx-prod-terraform-state", "shopx-prod-tf-state"],
        "cloudfront_dist": ["x-shop-prod-frontend"], "cloudfront_oac": ["x-shop-prod-frontend"],
        "log_group": ["x/shop/prod", "/shop/cloud-log-group-spark", "/shop/ecs-api", "/aws/eks/shop-k8-prod-us-east-1",
                      "/aws/rds/cluster/shop-prod-aurora-cluster/postgresql", "/aws/ecs/containerinsights/shop-prod-cluster/performance"],
        "secret": ["shop/prod/x"],
    }
    shapes = resources.shapes_by_type()
    assert set(one_of_a_kind) == set(shapes)
    for kind, names in one_of_a_kind.items():
        frame = spark.createDataFrame([(n,) for n in [*names, "other"]], "n string")
        tests = [resources.fits(naming, [rule], F.col("n"), F.lit("us-east-1")).alias(f"t{i}") for i, rule in enumerate(shapes[kind])]
        rows = {r["n"]: list(r)[1:] for r in frame.select("n", *tests).collect()}
        assert not any(rows.pop("other"))
        # Each name is told by one shape alone, and each shape by one of the names.
        assert sorted(hits.index(True) for hits in rows.values() if sum(hits) == 1) == list(range(len(tests))), kind
