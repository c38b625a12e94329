from almagest.llm.packing import fill_report, pack


def test_repeated_and_unnamed_oversized_items(spark):
    """Rows of the same id, or of none, don't share containers."""
    rows = [(7, 300), (7, 300), (7, 300), (8, 256), (None, 256), (None, 256), (None, 400)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", {1: 128, 2: 200})
    for spec, capacity in ((1, 128), (2, 200)):
        one = packed.filter(f"spec_id = {spec}").toPandas()
        assert one.groupby("container_id")["size"].sum().max() <= capacity
        full = one[one["size"] == capacity]
        assert len(full) == sum(n // capacity for _, n in rows) and full.container_id.is_unique
    assert all(r.fullest <= r.capacity and r.fill <= 1 for r in fill_report(packed, {1: 128, 2: 200}).collect())
