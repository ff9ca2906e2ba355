import pytest

from mdframe import Engine, QueryError
from mdframe.config import ConfigError, header_color, load_config
from mdframe.output.formats import enforce_scalars, header, to_csv, to_json, to_table, width, widths, wrap, write_parts

ROWS = [{"port": "Bergen", "ships": 41}, {"port": "Ostia", "ships": 7}, {"port": "Qui Nhon", "ships": 128}]
# The glyphs of a table's frame.
TOP, MIDDLE, BOTTOM, SIDE, LINE = "┌┬┐", "├┼┤", "└┴┘", "│", "─"


def test_table():
    rule = lambda ends, *sizes: ends[0] + ends[1].join(LINE * n for n in sizes) + ends[2]
    row = lambda form, *cells: SIDE + SIDE.join(form.format(c.ljust(n)) for c, n in zip(cells, (8, 5), strict=True)) + SIDE
    cells = [("PORT", "SHIPS"), ("Bergen", "41"), ("Ostia", "7"), ("Qui Nhon", "128")]
    wide = [row(" {} ", *c) for c in cells]
    between = rule(MIDDLE, 10, 7)
    assert to_table(ROWS, ["port", "ships"]).split("\n") == [rule(TOP, 10, 7), wide[0], between, wide[1], between, wide[2], between, wide[3], rule(BOTTOM, 10, 7)]
    tight = [row("{} ", *c) for c in cells]
    assert to_table(ROWS, ["port", "ships"], compact=True).split("\n") == [rule(TOP, 9, 6), tight[0], rule(MIDDLE, 9, 6), *tight[1:], rule(BOTTOM, 9, 6)]
    assert to_table([], ["a"]) == "No results"
    assert "日本" in to_table([{"a": "日本"}], ["a"]) and width("日本") == 4
    assert wrap("one two three", 7) == ["one two", "three"] and wrap("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert widths([5, 5], 20) == [5, 5] and sum(widths([50, 50], 40)) <= 40 and widths([9, 9, 9], 60, "20,*,50%")[0] == 20
    assert to_table([{"a": "x " * 30}], ["a"], total=20, most_lines=2).count("\n") == 5


def test_headers():
    assert [header("due_date", f) for f in ("none", "upper", "capitalize", "camel-case", "pascal-case")] == ["due date", "DUE DATE", "Due Date", "dueDate", "DueDate"]


def test_csv_and_json():
    assert to_csv([{"a": "=1+1", "b": None, "c": [1, 2]}], ["a", "b", "c"]) == "a,b,c\n'=1+1,,\"1,2\"\n"
    assert to_csv([], ["a"]) == ""
    assert '"port": "Ostia"' in to_json(ROWS)


def test_trim_and_colours(monkeypatch):
    rows = [{"a": " x\ty|z ", "b": " p|q"}]
    assert "x y z" in to_table(rows, ["a", "b"]) and " p|q" in to_table(rows, ["a", "b"], trim="1,0") and "\t" in to_table(rows, ["a", "b"], trim=None)
    assert "\x1b[1;31m" in to_table(ROWS, ["port"], color="1;31") and "\x1b" not in to_table(ROWS, ["port"])
    monkeypatch.setenv("MDFRAME_COLORS", "0;35")
    assert header_color(None, {}) == "0;35" and header_color(False, {}) is None and header_color(None, {"color": False}) is None
    monkeypatch.delenv("MDFRAME_COLORS")
    monkeypatch.setenv("LS_COLORS", "fi=0:di=01;34")
    assert header_color(None, {"colors": "7"}) == "01;34"


def test_parts(spark, tmp_path):
    frame = spark.createDataFrame([(1, "=x", [1, 2]), (2, None, None)], "n long, t string, a array<long>").repartition(2)
    write_parts(frame, str(tmp_path / "c"), "csv")
    write_parts(frame, str(tmp_path / "j"), "json")
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True).collect())) == [("1", "'=x", "1,2"), ("2", None, None)]
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(QueryError, match="Scalar value error"):
        write_parts(spark.sql("select struct(1 as a) as s"), str(tmp_path / "s"), "csv")


def test_scalars(spark):
    e = Engine(spark)
    e.register("t", spark.sql("select array(struct('a' as title)) as h, 1 as n"))
    enforce_scalars(e.sql("select n, h.map('title') as t from t").frame)
    with pytest.raises(QueryError, match="Scalar value error.*h.*array of maps.*h.map\\('title'\\)"):
        enforce_scalars(e.sql("select h from t").frame)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("format: csv\nrows: 3\nunknown: x\n")
    assert load_config(str(path)) == {"format": "csv", "rows": 3}
    path.write_text("rows: many\n")
    with pytest.raises(ConfigError, match="Invalid config: rows"):
        load_config(str(path))
    assert load_config(str(tmp_path / "none")) == {}
