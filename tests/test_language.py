import pytest

from mdframe.lang import QueryError, parse, tokenize
from mdframe.lang import tree as t


def test_tokens_and_places():
    got = tokenize('select a.b,\n "x\\"y" 1.5 /n/')
    assert [x.kind for x in got] == ["select", "name", ".", "name", ",", "string", "number", "/", "name", "/", "end"]
    assert got[5].value == 'x"y' and (got[5].line, got[5].column) == (2, 2)


def test_regex_after_parenthesis_only():
    assert tokenize("grep(/a\\/b/i)")[2].value == ("a\\/b", "i")


@pytest.mark.parametrize("text, message", [("select 'a", "Unterminated string"), ("select a ~ b", "Unexpected character '~'"), ("select (a", "Expected )"), ("select a b c", "Unexpected token"), ("select x.filter(1)(2)", "Cannot call"), ("", "Unexpected token")])
def test_errors(text, message):
    with pytest.raises(QueryError, match=message.replace("(", r"\(").replace(")", r"\)")):
        parse(text)


def test_precedence():
    e = parse("select where a = 1 or b = 2 and not c = 3").where
    assert e.op == "or" and e.right.op == "and" and isinstance(e.right.right, t.Unary) and e.right.right.of.op == "="
    p = parse("select 1 + 2 * 3 ^ 2 ^ 2").fields[0].expr
    assert p.op == "+" and p.right.op == "*" and p.right.right.op == "^" and p.right.right.right.op == "^"
    n = parse('select where title not contains "x" and b = 1').where
    assert n.op == "and" and n.left.op == "not"


def test_names_of_fields():
    names = [t.label(f.expr) for f in parse("select a, count(*), f(a, 'x'), x.m(1), x[0], x.key, a = 2, not a, 'lit', h1[0].title").fields]
    assert names == ["a", "count(*)", 'f(a, "x")', "x.m(1)", "x[0]", "x.key", "a_=_2", "NOT_a", '"lit"', "h1[0].title"]


def test_statements():
    u = parse('update set a:number = 1, b = "x" where id = 2')
    assert u.where is not None and u.assigns[0].hint == "number"
    assert parse("create set title = 'a' status = 'b'").assigns[1].name == "status"
    tr = parse("after create where new.a = 1 set b = 2")
    assert (tr.timing, tr.event) == ("after", "create") and tr.assigns
    assert parse('before delete run "x"').run == "x"
    assert parse("select | clipboard()").name == "clipboard"
    q = parse("select a from t x left join u on x.id = u.id cross join v where a in (select b from w) group by a having count(*) > 1 order by a desc limit 2 offset 1")
    assert [j.kind for j in q.joins] == ["left", "cross"] and q.limit == 2 and q.order[0].descending
    chain = parse("select a union all select b union all select c union select d")
    assert not chain.keep_all and len(chain.parts) == 2 and chain.parts[0].keep_all and len(chain.parts[0].parts) == 3
    assert parse("select `order` from t").fields[0].expr == t.Name("order")
