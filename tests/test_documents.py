import json
import os

import pytest

from mdframe import Engine, QueryError
from mdframe.markdown.index import grep_text, outline_text, parse_index
from mdframe.operators.mutate import trigger_frame
from mdframe.sources.documents import IgnoreRules, list_files, split_front

TASKS = {
    "anchor.md": "---\nid: 1\ntitle: Weigh anchor\nstatus: moored\nfleet: 7\npriority: 3\ntags: [deck, crew]\ncreatedAt: 2025-03-02T06:30:00Z\n---\n\nTwo hands at the winch.",
    "ballast.md": "---\nid: 2\ntitle: Trim ballast\nstatus: sailed\nfleet: 7\npriority: 5\ntags: [hold, pumps]\ncreatedAt: 2025-03-05T06:30:00Z\n---\n\nPump the aft tank dry.",
    "chart.md": "---\nid: 3\ntitle: Mark chart\nstatus: docked\nfleet: 8\npriority: 1\ncreatedAt: 2025-03-09T06:30:00Z\n---\n\nShoals east of the light.",
}
BODY = """---
title: Galley Book
---
# Provisions

Salt the fish first.

## Stores

Count the barrels twice.

```sh
ls hold
```

```sql
select barrels;
```

[manifest](https://ships.example/manifest)

![the hold](hold.png)

> Warning: rats below.

- [ ] buy lemons
- [x] patch sacks

| Item | Tons |
|------|------|
| rice | 12   |
"""


def make(folder, files):
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return str(folder)


def engine(spark, folder, **options):
    e = Engine(spark)
    e.register_directory(str(folder), **options)
    return e


def rows(e, q):
    return e.sql(q).rows()


def test_selects(spark, tmp_path):
    e = engine(spark, make(tmp_path, TASKS))
    assert len(rows(e, "select")) == 3
    assert set(rows(e, "select *")[0]) == {"id", "title", "status", "fleet", "priority", "tags", "createdAt", "filename", "path", "abspath", "filepath", "source_dir"}
    assert [r["title"] for r in rows(e, 'select title where status = "moored"')] == ["Weigh anchor"]
    assert [r["priority"] for r in rows(e, "select priority order by priority desc")] == [5, 3, 1]
    assert [r["id"] for r in rows(e, "select id order by priority limit 2")] == [3, 1]
    assert len(rows(e, "select distinct fleet")) == 2
    assert [r["id"] for r in rows(e, 'select id where tags any = "deck"')] == [1]
    assert rows(e, "select fleet, count(*) group by fleet having count(*) > 1") == [{"fleet": 7, "count(*)": 2}]
    assert rows(e, "select title, count(*) as n group by fleet having count(*) > 1") == [{"title": "Weigh anchor", "n": 2}]
    assert len(rows(e, 'select where has(tags) and not status = "sailed"')) == 1
    assert len(rows(e, 'select where nonexistent != "value"')) == 3 and not rows(e, 'select where nonexistent = "value"')
    assert [r["id"] for r in rows(e, 'select id where createdAt > "2025-03-04"')] == [2, 3]
    assert rows(e, "select content() where id = 1") == [{"content()": "Two hands at the winch."}]
    assert rows(e, 'select fields("*t*") as f where id = 1') == [{"f": ["title", "status", "fleet", "priority", "tags", "createdAt"]}]
    meta = rows(e, "select file().size as s, file().mode as m where id = 1")[0]
    assert meta["s"] == os.path.getsize(tmp_path / "anchor.md") and len(meta["m"]) == 9


def test_presence_and_limits(spark, tmp_path):
    e = engine(spark, make(tmp_path, {"a.md": "---\ntitle: Has Title\nstatus: todo\n---\n", "b.md": "---\nstatus: doing\n---\n", "c.md": "plain", "d.md": "---\ntitle: null\n---\n"}))
    assert len(rows(e, "select title")) == 2  # an explicit null counts as there
    assert not rows(e, "select name")
    assert len(rows(e, "select title, status")) == 3
    assert len(rows(e, "select *")) == 4
    e = engine(spark, make(tmp_path / "seq", {f"f{i}.md": f"---\nseq: {i}\n" + (f"title: T{i}\n" if i > 2 else "") + "---\n" for i in range(1, 5)}))
    assert [r["title"] for r in rows(e, "select title order by seq limit 1 offset 1")] == ["T4"]
    assert len(rows(e, "select title order by seq limit 10")) == 2


def test_errors_and_types(spark, tmp_path):
    e = engine(spark, make(tmp_path, {"good.md": "---\ntitle: Good\nn: 1\non: yes\n---\nBody", "bad.md": '---\nname: "broken\nd: x\n---\n', "m.md": "---\nn: 2.5\non: true\nmap: {a: 1}\n---\n"}))
    assert sorted(r["n"] for r in rows(e, "select n")) == [1.0, 2.5]
    assert sorted(r["on"] for r in rows(e, "select `on`")) == ["true", "yes"]
    assert rows(e, "select map.a as a where has(map)") == [{"a": "1"}]
    bad = e.table(None).errors.collect()
    assert len(bad) == 1 and bad[0]["phase"] == "read" and bad[0]["path"].endswith("bad.md")
    with pytest.raises(QueryError, match="Cannot index non-array"):
        e.sql("select title[0]")
    with pytest.raises(QueryError, match="Unknown builtin: nope"):
        e.sql("select nope(title)")


def test_body(spark, tmp_path):
    e = engine(spark, make(tmp_path, {"body.md": BODY}))
    one = lambda q: rows(e, q)[0]
    h1 = one("select h1")["h1()"]
    assert one("select h1[0].title") == {"h1()[0].title": "Provisions"} and one("select link.map('url')") == {'link().map("url")': ["https://ships.example/manifest"]}
    assert (h1[0]["title"], h1[0]["level"], h1[0]["content"]) == ("Provisions", 1, "Salt the fish first.")
    got = one("select h1[0].title as a, code.count() as b, code[0].lang as c, code('sql').count() as d, table[0].headers.map('content') as e, body.h1[0].title as f")
    assert got == {"a": "Provisions", "b": 2, "c": "sh", "d": 1, "e": ["Item", "Tons"], "f": "Provisions"}
    got = one("select listItem.filter(checked = false).map('content') as a, h1('Nope').count() as b, link('https*').count() as c, blockquote('*Warning*').count() as d")
    assert got == {"a": ["buy lemons"], "b": 0, "c": 1, "d": 1}
    assert rows(e, 'select title where h1.filter(title matches "Provisions|Stores").count() > 0') == [{"title": "Galley Book"}]
    assert [(x["level"], x["title"]) for x in one("select toc() as t")["t"]] == [(1, "Provisions"), (2, "Stores")]
    assert one("select toc().filter(title starts_with 'Pro').count() as n")["n"] == 1
    assert one("select section('Stores').content as c")["c"].startswith("Count the barrels twice.")


def test_markdown_counts():
    doc = (
        "# A\n\n*em* **strong** `code` [l](http://x) ![i](p.png) ~~gone~~ hard  \nbreak[^1] [ref][ref-id] ![im][img-ref]\n\n## B\n\n### C\n\n```js\nx\n```\n\n> q\n\n"
        "- plain\n- [ ] open\n- [x] done\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<div>h</div>\n\n[^1]: note\n[ref-id]: http://r\n[img-ref]: http://i \"T\"\n"
    )
    o = parse_index(doc)
    assert {k: len(v) for k, v in o.items() if k.startswith("el_")} == {
        "el_link": 1, "el_linkRef": 1, "el_image": 1, "el_imageRef": 1, "el_code": 1, "el_inlineCode": 1, "el_table": 1, "el_list": 1, "el_listItem": 3,
        "el_blockquote": 1, "el_p": 6, "el_html": 1, "el_em": 1, "el_strong": 1, "el_del": 1, "el_break": 1, "el_footnote": 1, "el_def": 2,
    }
    assert [x["checked"] for x in o["el_listItem"]] == [None, False, True]
    assert not any(parse_index("").values()) and not any(parse_index(None).values())
    assert [h["level"] for h in parse_index("# A\n## B\n### C\n# D")["headings"]] == [1, 2, 3, 1]
    assert [h["hierarchy"] for h in parse_index("# Top\n\n## Mid\n\n## Next\n\n### Deep\n")["headings"]] == [[], ["Top"], ["Top"], ["Top", "Next"]]
    assert [h["content"] for h in parse_index("# TODO\n\nLine one.\nLine two.\n\n## Other\n\nOther stuff.\n")["headings"]] == ["Line one.\nLine two.", "Other stuff."]
    assert [(h["title"], h["level"]) for h in parse_index("Title\n===\n\nSub\n---\n\n# not `# code`\n\n```\n# no\n```\n")["headings"]] == [("Title", 1), ("Sub", 2), ("not # code", 1)]
    assert parse_index("a *b **c** d* \\*e\\* __f__ snake_case_word")["el_em"][0]["content"] == "b c d"
    assert [x["content"] for x in parse_index("a __f__ snake_case_word ***x***")["el_strong"]] == ["f", "x"]
    nested = parse_index("- a\n  - b\n    - c\n- d\n")["el_listItem"]
    assert [(i["content"], len(i["children"])) for i in nested] == [("abc", 1), ("bc", 1), ("c", 0), ("d", 0)]


def test_grep_and_outline():
    at = lambda s, p: [(g["line"], g["column"]) for g in grep_text(s, p)]
    assert at("# Log\n\nAll hands REEF sails.\n", "REEF") == [(3, 10)]
    assert at("# Log\n\nWind is up\nREEF at dusk.\n", "REEF") == [(4, 0)]
    assert grep_text("The sea was calm. At noon we had to REEF again.\n", "REEF")[0]["sentence"] == "At noon we had to REEF again."
    g = grep_text("Ask [the REEF crew](https://crew.example) first.\n", "REEF")[0]
    assert g["paragraph"] == "Ask the REEF crew first." and [a["type"] for a in g["ancestors"]] == ["root", "paragraph", "link"]
    assert grep_text("# Voyage\n\n## Storm\n\nThen REEF all.\n", "REEF")[0]["section"] == ["Voyage", "Storm"]
    assert [x["captures"] for x in grep_text("Knots: run(9) then run(14).\n", r"run\((\d+)\)")] == [["9"], ["14"]]
    assert outline_text([(1, "A"), (2, "B"), (2, "C")], 2) == "└── A\n    ├── B\n    └── C"


def test_toc_membership(spark, tmp_path):
    e = engine(spark, make(tmp_path, {"one.md": "# Ship\n## Mast\n### Splice\n## Keel\n", "three.md": "# Ship\n## Mast\n## Hull\n", "two.md": "# Ship\n## Hull\n## Keel\n"}))
    names = lambda q: [r["filename"] for r in rows(e, f"select filename where {q}")]
    assert names('"Mast" in toc()') == names('has section("Mast")') == ["one", "three"]
    assert names('has_section("Hull")') == ["three", "two"] and not names('"none" in toc()')


def test_discovery(spark, tmp_path):
    make(tmp_path, {"top.md": "t", "sub/mid.md": "m", "sub/deep/deep.md": "d", ".hidden/secret.md": "s", "node_modules/dep.md": "n", "ignored.md": "i", ".gitignore": "ignored.md\nnode_modules/\n", ".git/x.md": "g"})
    found = lambda **k: [os.path.basename(p) for p in list_files(str(tmp_path), **k)]
    assert found() == ["top.md", "mid.md", "deep.md"]
    assert found(depth=1) == ["top.md"] and found(depth=2) == ["top.md", "mid.md"]
    assert "secret.md" in found(hidden=True) and "dep.md" in found(ignore=False) and "x.md" not in found(hidden=True, ignore=False)
    assert [r["path"] for r in rows(engine(spark, tmp_path, files=["sub/mid.md"]), "select path")] == ["sub/mid.md"]
    rules = IgnoreRules("*.log\n!keep.log\n/only\nsub/**/x\n")
    assert rules.ignores("a/b.log", False) and not rules.ignores("keep.log", False) and rules.ignores("only", True) and not rules.ignores("a/only", True)
    assert rules.ignores("sub/a/b/x", False)


def test_many_directories(spark, tmp_path):
    a, b = make(tmp_path / "a", {"a.md": "---\ntitle: Alpha\n---\n"}), make(tmp_path / "b", {"b.md": "---\ntitle: Beta\nn: 1\n---\n"})
    e = Engine(spark)
    e.register_directory(a, b, str(tmp_path / "none"))
    assert [(r["title"], r["source_dir"]) for r in rows(e, "select title, source_dir")] == [("Alpha", a), ("Beta", b)]
    assert [r["phase"] for r in e.table(None).errors.collect()] == ["list"]
    remote = Engine(spark)
    remote.register_directory("file://" + a)
    assert [r["title"] for r in rows(remote, "select title, path")] == ["Alpha"]


def test_staged_directory(spark, tmp_path):
    folder = make(tmp_path / "notes", TASKS)
    e = engine(spark, folder, stage=str(tmp_path / "stage"))
    os.unlink(os.path.join(folder, "anchor.md"))
    assert [r["title"] for r in rows(e, "select title order by title")] == ["Mark chart", "Trim ballast", "Weigh anchor"]
    assert "MapInArrow" not in e.explain("select title") and rows(e, "select h1.count() as n, file().size > 0 as s limit 1") == [{"n": 0, "s": True}]


def test_empty_directory(spark, tmp_path):
    assert rows(engine(spark, tmp_path), "select filename") == []


def test_mutations(spark, tmp_path):
    folder = make(tmp_path, TASKS)
    e = engine(spark, folder)
    assert e.sql('update where id = 1 set status = "docked", tags = tags + ["x"], priority = priority + 1').updated == 1
    e = engine(spark, folder)
    assert rows(e, "select status, tags, priority, body where id = 1") == [{"status": "docked", "tags": ["deck", "crew", "x"], "priority": 4, "body": "Two hands at the winch."}]
    assert e.sql('create title = "Paint hull" status = "moored" file = "paint-hull"').created == 1
    assert os.path.exists(tmp_path / "paint-hull.md")
    with pytest.raises(QueryError, match="create requires path to file"):
        e.sql('create title = "Adrift"')
    assert e.sql("delete where id = 3").deleted == 1 and not os.path.exists(tmp_path / "chart.md")
    with pytest.raises(QueryError, match="delete requires a where clause"):
        e.sql("delete")
    with pytest.raises(QueryError, match="no file with id '99'"):
        engine(spark, folder).sql("update where id = 99 set a = 1")
    with pytest.raises(QueryError, match="immutable"):
        e.sql('update where id = 1 set createdAt = "x"')
    assert split_front("---\na: 1\n---\n\nbody\n") == ({"a": 1}, "body\n")


def test_triggers(spark):
    old = spark.createDataFrame([(1, "todo", 1), (2, "done", 5)], "id long, status string, n long")
    new = spark.createDataFrame([(1, "done", 2), (2, "todo", 6)], "id long, status string, n long")
    e = Engine(spark)
    denied = trigger_frame(e, 'before update where old.status = "done" deny "closed"', old, new).orderBy("id").collect()
    assert [r["denied"] for r in denied] == [None, "closed"]
    made = trigger_frame(e, "before update where new.n > old.n set n = old.n + 100, mark = 'x'", old, new).orderBy("id").collect()
    assert [(r["n"], r["mark"]) for r in made] == [(101, "x"), (105, "x")]
    with pytest.raises(QueryError):
        trigger_frame(e, 'after update run "x"', old, new)


def test_triggers_of_statements(spark, tmp_path):
    """A trigger statement holds for later statements on its table: it sees old and new rows, denies or sets, before and after."""
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, kind string, n long"))
    e.sql('before update where new.n > 100 deny "too many"')
    e.sql("before update where new.n > old.n set kind = old.kind + '+', n = new.n + 1")
    e.sql("after update where old.n = 5 set kind = new.kind + '!'")
    e.sql('before create where new.n < 0 deny "negative"')
    e.sql("before create where not has(old) set kind = 'made'")
    e.sql('before delete where old.id = 2 deny "kept"')
    changed = lambda q: sorted((r["id"] or 0, r["kind"], r["n"]) for r in rows(e, q))
    assert changed("update set n = n + 10") == [(1, "a+", 12), (2, "b+!", 16)]
    assert changed("update where id = 1 set n = 0") == [(1, "a", 0), (2, "b", 5)]
    assert changed("create id = 3 n = 4")[2] == (3, "made", 4) and changed("delete where id = 1") == [(2, "b", 5)]
    for q, message in (("update set n = 101", "too many"), ("create id = 3 n = -4", "negative"), ("delete where n > 0", "kept")):
        with pytest.raises(QueryError, match=message):
            e.sql(q)
    with pytest.raises(QueryError, match="run commands"):
        e.sql('after update run "x"')
    folder = make(tmp_path, TASKS)
    e = engine(spark, folder)
    e.sql("before update where old.fleet = 7 set mark = 'seven', priority = new.priority * 2")
    assert e.sql("update where priority >= 3 set priority = priority + 1").updated == 2
    assert sorted((r["id"], r["priority"], r["mark"]) for r in rows(engine(spark, folder), "select id, priority, mark where id < 3")) == [(1, 8, "seven"), (2, 12, "seven")]


def test_pipes_and_errors(spark, tmp_path):
    folder, copied, seen = make(tmp_path, TASKS | {"bad.md": "---\na: [\n---\n"}), [], []
    e = Engine(spark, hooks={"on_error": seen.append}, actions={"keep": lambda result, *a: copied.append((a, result.rows()))})
    e.register_directory(folder, str(tmp_path / "none"))
    assert sorted(x["phase"] for x in seen) == ["list", "read"]
    assert e.sql("select id order by id limit 1 | keep('x', 2)").action == ("keep", ("x", 2)) and copied == [(("x", 2), [{"id": 1}])]
    assert len(e.sql("select id | unknown()").rows()) == 3


def test_hooks_of_values_and_writes(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = make(tmp_path, TASKS)
    written = []
    e = Engine(spark, hooks={"on_evaluate_value": lambda c, name: F.upper(c) if name == "title" else c, "on_before_write": lambda row, kind: (written.append(kind), row.update(mark=kind))})
    e.register_directory(folder)
    assert rows(e, "select title where id = 1") == [{"title": "WEIGH ANCHOR"}]
    assert e.sql("update where id = 1 set mark = 'none'").updated == 1 and e.sql('create id = 9 file = "nine"').created == 1
    assert written == ["update", "create"] and sorted(r["mark"] for r in rows(engine(spark, folder), "select mark where has(mark)")) == ["create", "update"]


def test_exports():
    import mdframe

    assert all(callable(getattr(mdframe, n)) or n == "scalar_functions" for n in mdframe.__all__)
    assert "upper" in mdframe.scalar_functions
    reads = mdframe.prefilter("select title, h1[0].title where status = 'x' and file().size > 1")
    assert reads.body and reads.metadata and reads.elements == {"h1"} and not mdframe.prefilter("select title").body


def test_one_parse(spark, tmp_path):
    e = engine(spark, make(tmp_path, {"a.md": BODY}))
    plan = e.explain("select grep(/barrels/).count() as a, grep(/rats/i)[0].line as b, outline() as c, body.outline as d, h1[0].title as e, link.count() as f").split("== Physical Plan ==")[1]
    assert plan.count("ArrowEvalPython") == 1
    got = rows(e, "select grep(/barrels/).count() as a, grep(/rats/i).count() as b, outline(1) as c")
    assert got == [{"a": 1, "b": 1, "c": "└── Provisions"}]


def test_hooks_and_functions(spark, tmp_path):
    folder = make(tmp_path, TASKS)
    seen = []
    e = Engine(spark, context={"me": "jane"}, hooks={"on_before_execute": lambda s: seen.append(s), "on_after_read": lambda f: f.where("id < 3")})
    e.register_directory(folder)
    from pyspark.sql import functions as F

    e.register_function("shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    assert [r["s"] for r in rows(e, "select shout(title) as s where me = 'jane' order by id")] == ["WEIGH ANCHOR!", "TRIM BALLAST!"]
    assert seen


def test_cli(spark, tmp_path, capsys):
    from mdframe.cli import expand_dir, main, merge_dirs

    folder = make(tmp_path, TASKS)
    assert main(["--dir", folder, "--json", "select title where id = 1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["data"] == [{"title": "Weigh anchor"}]
    assert main(["--dir", folder, "-o", str(tmp_path / "out" / "x.csv"), "select id, title order by id limit 1"], spark) == 0
    assert (tmp_path / "out" / "x.csv").read_text() == "id,title\n1,Weigh anchor\n"
    assert main(["--dir", folder, "delete"], spark) == 1
    assert "delete requires a where clause" in capsys.readouterr().err
    assert main(["--dir", str(tmp_path / "no"), "select"], spark) == 1
    assert merge_dirs(["--dir", "a,", "b", "q"]) == ["--dir", "a,b", "q"]
    assert expand_dir("~") == os.path.expanduser("~")


def test_cli_input_and_flags(spark, tmp_path, capsys, monkeypatch):
    import io

    from mdframe.cli import main

    folder = make(tmp_path / "notes", TASKS)

    def run(*argv, text="", answers=None):
        stdin = io.StringIO(text)
        stdin.isatty = lambda: answers is not None
        monkeypatch.setattr("sys.stdin", stdin)
        monkeypatch.setattr("builtins.input", lambda _: answers)
        code = main(["--dir", folder, *argv], spark)
        return code, *capsys.readouterr()

    assert json.loads(run("--json", "-", text="select id where id = 2")[1])["data"] == [{"id": 2}]
    assert run("--csv", "-f", "-", "select path", text="anchor.md\nchart.md\n")[1].split() == ["path", "anchor.md", "chart.md"]
    assert run("--csv", "-f", "chart.md", "select path")[1].split() == ["path", "chart.md"]
    assert "FLEET" in run("--no-color", "select fleet")[1] and "Fleet" in run("--title-format", "capitalize", "select fleet")[1]
    assert run("--compact", "--rows", "1", "--columns", "6", "select title")[1].count("\n") == 7
    assert run("update where id = 1 set priority = 9")[0] == 1 and run("update where id = 1 set priority = 9", answers="n")[0] == 1
    assert run("update where id = 1 set priority = 9", answers="y")[:2] == (0, "1 updated\n") and run("-y", "delete where id = 1")[0] == 0
    assert run("--parts", "select id")[0] == 1 and run("--parts", "--json", "-o", str(tmp_path / "parts"), "select id, title")[0] == 0
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "parts")).collect()) == [2, 3]
    assert run("", text="")[0] == 1 and run("select (")[0] == 1
