"""Lines keep the order of files and places, and no path goes through the sort."""

from graphloom.sources.base import lines


def test_lines_go_by_file_and_place(spark, tmp_path):
    for name, said in (("b", ["3", " ", "4"]), ("a é%20", ["1", "2"]), ("c", ["5"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(said) + "\n")
    found = lines(spark, str(tmp_path / "*.txt"))
    assert [r["value"] for r in found.orderBy("ord").collect()] == ["1", "2", "3", "4", "5"]
    ranged = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(ranged) == 1 and "_f#" not in ranged[0]
    assert "_n#" in ranged[0]
