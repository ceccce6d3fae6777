"""Lines of shapes: two routes in one shape, and no sort of all points for the aggregate."""

import re

from busweave.operators import matching as M


def test_points_are_combined_without_a_sort(spark):
    rows = [(1, "a", 2, 30.0, -25.0, -49.1), (1, "a", 1, 10.0, -25.0, -49.0), (1, "b", 3, 70.0, -25.0, -49.3), (2, None, 1, 5.0, None, -49.0)]
    shapes = spark.createDataFrame(rows, "shape long, route string, seq long, dist double, lat double, lon double")
    lines = M.shape_lines(shapes)
    one, two = sorted(lines.collect(), key=lambda r: r.shape)
    assert (one.points, one.total_m, one.start_lon, one.end_lon) == (3, 70.0, -49.0, -49.3) and one.route in ("a", "b")
    assert one.greatest_gap_m > 20_000  # from the second to the third point, across the routes
    assert (two.points, two.route, two.start_lat, two.end_lon, two.greatest_gap_m) == (1, None, None, -49.0, 0.0)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[shape#\d+L?, route#\d+\], functions=\[partial_count", plan)
