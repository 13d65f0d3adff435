"""Descriptor blocks travel as stored."""

from raytable.operators import matching


def test_blocks_keep_the_type_of_their_vectors(spark):
    a = spark.createDataFrame([(k, [k / 3.0, 1.0, k * k / 7.0]) for k in range(50)], "vec_id long, embedding array<float>")
    assert matching._blocks(a, [], "vec_id", "embedding", "a").schema["_a"].dataType.elementType["v"].dataType.simpleString() == "array<float>"
    b = a.selectExpr("vec_id + 100 as vec_id", "embedding")
    got = {tuple(r) for r in matching.match_descriptors(a, b, [], "vec_id", "embedding", 0.8).select("vec_id_a", "vec_id_b", "distance").collect()}
    assert got == {(k, k + 100, 0.0) for k in range(50)}
