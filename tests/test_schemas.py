from pyspark.sql import functions as F

from hirespan import schemas
from hirespan.operators.tables import JOB_COLUMNS


def test_every_schema_is_readable(spark):
    for table in schemas.TABLES:
        names = schemas.schema_of(table).names
        assert len(names) == len(set(names)) and set(schemas.KEYS.get(table, [])) <= set(names)
        assert set(schemas.NEEDED.get(table, [])) <= set(names)
    assert schemas.schema_of("jobs").names == JOB_COLUMNS


def test_rules(spark):
    rows = [("a@b", "A", "PUBLIC"), (None, "A" * 121, "HIDDEN"), ("a@b", "B", "PRIVATE")]
    frame = spark.createDataFrame(rows, "email string, display_name string, profile_visibility string")
    found = schemas.violations(frame, "users").collect()
    assert [r.reasons for r in found] == [["email is missing", "display_name is too long", "profile_visibility is not allowed"]]
    assert [tuple(r) for r in schemas.repeated_keys(frame, "users").collect()] == [("a@b", 2)]
    nulls = spark.range(2).select(F.lit(None).cast("string").alias("email"))
    assert schemas.repeated_keys(nulls, "users").count() == 0
