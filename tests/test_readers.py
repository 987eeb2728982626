"""What it takes to read labelled pairs."""

import json

import pytest

from newsloom.sources import readers


def test_a_pair_is_parsed_once(spark, tmp_path):
    """No check parses a line for each of its fields, none takes a pattern to a whole line."""
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(json.dumps({"a": f"x/{k}", "b": "y", "label": "same"}) for k in range(50)))
    lines = readers._parsed(spark.read.text(str(path)))
    for df in (readers._bad(lines), lines.select("p.*")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and "regexp_replace" not in plan


def test_blank_lines_of_all_kinds(spark, tmp_path):
    path = tmp_path / "pairs.jsonl"
    pair = '{"a": "x", "b": "y", "label": "different"}'
    path.write_text(f"\n \t\n 　﻿\n {pair}\n", encoding="utf-8")
    with pytest.raises(ValueError, match="line 4 is not a labelled pair"):
        readers.labelled_pairs(spark, str(path))
    path.write_text(f"\n \t\n 　﻿\n \t{pair} \n", encoding="utf-8")
    assert [tuple(r) for r in readers.labelled_pairs(spark, str(path)).collect()] == [("x", "y", "different")]
