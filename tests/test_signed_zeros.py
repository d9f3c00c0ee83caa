import duckdb
import numpy as np

from lodestar.plans import table_queries as Q


def test_remapped_coordinates_are_those_of_sql(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((40, 64)).astype(np.float32)
    x[3, 63], x[4, 56], x[5, 49], x[6, 42], x[7, 35] = -1e-7, 1e-7, -0.0, -5.1e-7, 1 / 128
    spark.createDataFrame([(k, [float(z) for z in v], 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.v for r in Q.remap_dims(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = dict(con.sql(Q.ORACLES["remap_dims"]).fetchall())
    assert got.keys() == want.keys() and all(np.array(got[k]).tobytes() == np.array(want[k]).tobytes() for k in want)  # signs of zeros too
