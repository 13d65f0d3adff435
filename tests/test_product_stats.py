"""Product statistics make their catalog once."""

from raytable.operators import catalog


def test_product_stats_store_the_two_columns_they_need(spark, monkeypatch):
    rows = [("raw", str(k), None if k == 3 else k / 8.0) for k in range(8)] + [("none", "x", None)]
    made, df = [], spark.createDataFrame(rows, "product string, point_id string, uncertainty double")
    monkeypatch.setattr(catalog, "stored", lambda df, plain=catalog.stored: made.append(df.columns) or plain(df))
    got = {tuple(r) for r in catalog.product_stats(df, 0.25).collect()}
    assert got == {("raw", 8, 7, 3, 0.5), ("none", 1, 0, 0, None)}
    assert made == [["product", "uncertainty"]]
