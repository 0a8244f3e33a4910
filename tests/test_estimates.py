"""Tables made by explode look small to Spark; none of them may be collected on the driver for a broadcast."""

import re

import pytest

from __spark_entry__ import queries


def broadcasts(df):
    """The text of every subtree of the first plan below a broadcast."""
    lines = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:|+-]*", line)[0]) for line in lines]
    out = []
    for i, line in enumerate(lines):
        side = re.search(r"BroadcastHashJoin .*Build(Left|Right)", line)
        if side:
            below = [j for j in range(i + 1, len(lines)) if depth[j] > depth[i]]
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            children = [j for j in below if j < end and depth[j] == depth[i + 1]]
            start = children[0] if side[1] == "Left" else children[1]
            stop = children[1] if side[1] == "Left" else end
            out.append("\n".join(lines[start:stop]))
    return out


CELLS = ["ras_12_class_partition_cdr", "ras_12_class_partition_detector", "ras_13_overlap_audit", "agg_20_class_budget_field", "agg_26_union_footprint", "agg_29_start_diagnostics", "sta_14_normalised_contrasts", "sta_21_reverse_window_metrics"]


@pytest.mark.parametrize("name", CELLS)
def test_exploded_patch_cells_are_not_broadcast(spark, sf, name):
    found = broadcasts(queries()[name](spark, sf))
    assert not [b for b in found if "object_area_cells" in b and "Generate" in b]


@pytest.mark.parametrize("name", ["ras_10_edge_cells", "agg_17_region_window_loss", "agg_18_transition_budget"])
def test_exploded_grid_is_not_broadcast(spark, sf, name):
    found = broadcasts(queries()[name](spark, sf))
    assert not [b for b in found if "p_partkey" in b and "Generate" in b]


@pytest.mark.parametrize("name", ["ras_10_front_quality", "top_04_ras_10_front_rows", "ras_11_relative_wind"])
def test_fronts_of_points_are_not_broadcast(spark, sf, name):
    found = broadcasts(queries()[name](spark, sf))
    assert not [b for b in found if "grad_x" in b or "component" in b or "qa_status" in b]


def test_start_diagnostics_read_the_cells_once(spark, sf):
    plan = queries()["agg_29_start_diagnostics"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "object_area_cells" not in plan
