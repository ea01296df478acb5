"""Every row of an enumeration is kept."""

from terrella.operators import etl


def test_all_later_rows_are_group_b(spark):
    got = etl.enumerate_split(spark.range(11), "id", name="Bus", half=3).select("id", "row_id").collect()
    assert {r.id: r.row_id for r in got} == {i: f"Bus_A_{i + 1}" if i < 3 else f"Bus_B_{i - 2}" for i in range(11)}
