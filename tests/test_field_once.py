"""The field of a hit's text is parsed in one place of the plan, not again by the filter on it."""

from lexiquarry.catalog.tables import aliases
from lexiquarry.operators.hits import extremum_of_hits


def test_a_text_is_parsed_once(spark):
    asked = spark.createDataFrame([(1, "最贵的"), (2, "你好")], "query_id long, query string")
    found = spark.createDataFrame(
        [(1, 10, 1, "product_id: 3\nproduct_name: pen\nprice: 5"), (1, 11, 2, "product_id: 4\nproduct_name: cup\nprice: 7"), (1, 12, 3, "product_id: 5\nproduct_name: hat"), (2, 10, 1, "product_id: 3\nproduct_name: pen\nprice: 5")], "query_id long, doc_id long, rank int, content string"
    )
    out = extremum_of_hits(asked, found, aliases=aliases())
    assert [(r.query_id, r.doc_id, r.value, r["rank"]) for r in out.orderBy("rank").collect()] == [(1, 11, 7.0, 1), (1, 10, 5.0, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = [line.lstrip(" :+-").split()[0] for line in plan if "element_at" in line and line.lstrip(" :+-").startswith(("Filter", "Project", "Generate"))]
    assert nodes == ["Generate"]
