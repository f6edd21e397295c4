import pytest

from hitledger.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        app="hitledger-tests",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def requests_of(spark):
    """Rows with the stored schema from partial dicts; timestamps are ISO text in UTC."""
    from hitledger.functions.instants import utc
    from hitledger.schema import REQUEST_SCHEMA, conform

    def build(*rows: dict):
        names = sorted({k for r in rows for k in r})
        types = {f.name: f.dataType.simpleString() for f in REQUEST_SCHEMA.fields}
        schema = ", ".join(f"{n} {types[n]}" for n in names)
        data = [tuple(utc(r[n]) if types[n] == "timestamp" and n in r else r.get(n) for n in names) for r in rows]
        df = spark.createDataFrame(data, schema)
        return conform(df)

    return build
