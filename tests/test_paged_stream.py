"""The paged source as a stream: restarts read nothing twice; and filters that keep lists from being asked for."""

import pytest
from pyspark.sql import functions as F

from cursus.sources import remote

CLIENT = '''
HERE = "{folder}"


def page(list_id, token):
    """Pages of three records up to what the file `size` says; each request is noted."""
    first = int(token or 0)
    size = int(open(HERE + "/size").read())
    with open(HERE + "/asked", "a") as f:
        f.write("%s %d\\n" % (list_id, first))
    return [list_id + str(i) for i in range(first, min(first + 3, size))], str(first + 3) if first + 3 <= size else None


def follow(list_id, token):
    first = int(token or 0)
    return str(first + 3) if first + 3 <= int(open(HERE + "/size").read()) else None
'''


@pytest.fixture()
def client(tmp_path):
    (tmp_path / "client.py").write_text(CLIENT.replace("{folder}", str(tmp_path)))
    return f"{tmp_path}/client.py", tmp_path


def asked(folder):
    file = folder / "asked"
    return sorted(file.read_text().split("\n")[:-1]) if file.exists() else []


def run(spark, name, folder):
    rows = remote.paged_stream(spark, f"{name}:page", ["u", "v"], f"{name}:follow")
    stream = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return sorted(r["record"] for r in spark.read.schema("list_id string, page int, record string").parquet(f"{folder}/out").collect())


def test_a_restart_reads_nothing_twice(spark, client):
    name, folder = client
    (folder / "size").write_text("7")
    first = run(spark, name, folder)
    assert first == sorted(f"{x}{i}" for x in "uv" for i in range(6))  # the third page isn't full yet
    assert asked(folder) == ["u 0", "u 3", "v 0", "v 3"]
    assert run(spark, name, folder) == first and len(asked(folder)) == 4
    (folder / "size").write_text("13")
    assert run(spark, name, folder) == sorted(f"{x}{i}" for x in "uv" for i in range(12))
    assert asked(folder) == sorted(f"{x} {i}" for x in "uv" for i in (0, 3, 6, 9))


def test_filters_keep_lists_from_being_asked_for(spark, client):
    name, folder = client
    (folder / "size").write_text("5")
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = remote.paged(spark, f"{name}:page", ["u", "v", "w"])
        assert {r["record"] for r in df.where("list_id = 'v'").collect()} == {f"v{i}" for i in range(5)}
        assert {x[0] for x in asked(folder)} == {"v"}
        assert df.where(F.col("list_id").isin("u", "v") & (F.col("page") == 0)).count() == 6
        assert {x[0] for x in asked(folder)} == {"u", "v"} and df.where("list_id = 'none'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
