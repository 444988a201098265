import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ("point_encode", "cell_bbox", "centroid_rollup", "points_by_shape", "coverage_dedup", "geohash_merge", "activity_cycles", "radius_search", "area_expression", "great_circle_middle", "minus_cells", "mean_resolution", "point_in_rect", "anti_join", "geohash_cells", "rim_sides", "line_steps", "shapes_from_table", "wkt_holes", "shape_by_error", "document_frequency", "functions_in_sql", "kml", "envelope_rings", "geojson_coarse", "reduce_cells_of_users", "polygon_cells", "densified_tracks", "line_cover", "circle_cover")


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["hex", "points"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", FEW)
def test_query_agrees_with_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))
