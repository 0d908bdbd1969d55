import pytest

from docquarry.path import PathError, parse
from docquarry.path.syntax import text


@pytest.mark.parametrize(
    ("path", "steps"),
    [
        ("$", ()),
        ("$.a.b", (("name", "a"), ("name", "b"))),
        ("$.a b", (("name", "a b"),)),
        ("$['x.y'][\"z\"]", (("name", "x.y"), ("name", "z"))),
        (r"$['it\'s']", (("name", r"it\'s"),)),
        ("$[0][-1]", (("index", 0), ("index", -1))),
        ("$[1:3]", (("slice", 1, 3, None),)),
        ("$[::-2]", (("slice", None, None, -2),)),
        ("$.*[*]", (("all",), ("all",))),
        ("$..a", (("deep", ("name", "a")),)),
        ("$..*", (("deep", ("all",)),)),
        ("$..[2]", (("deep", ("index", 2)),)),
        ("$[0,2]", (("union", (("index", 0), ("index", 2))),)),
        ("$['a','b']", (("union", (("name", "a"), ("name", "b"))),)),
        ("$[(@.length-1)]", (("last",),)),
        ("$[( @.length-1 )]", (("last",),)),
        ("$[(@.length)]", (("none", "@.length"),)),
        ("$[?(@.a)]", (("filter", ("has", ("a",))),)),
        ("$[?(@)]", (("filter", ("true",)),)),
        ("$[?(@.a.b<1.5)]", (("filter", ("compare", "<", ("path", ("a", "b")), ("value", 1.5))),)),
        ("$[?(!@.a == 1)]", (("filter", ("not", ("compare", "==", ("path", ("a",)), ("value", 1.0)))),)),
        ("$[?(@.a || @.b && @.c)]", (("filter", ("or", ("has", ("a",)), ("and", ("has", ("b",)), ("has", ("c",))))),)),
        ("$[?((@.a || @.b) && @.c == null)]", (("filter", ("and", ("or", ("has", ("a",)), ("has", ("b",))), ("compare", "==", ("path", ("c",)), ("value", None)))),)),
        ("$[?('x' != @.a)]", (("filter", ("compare", "!=", ("value", "x"), ("path", ("a",)))),)),
    ],
)
def test_steps(path, steps):
    assert parse(path) == steps


@pytest.mark.parametrize("path", ["", "a", "$a", "$.", "$..", "$[", "$[]", "$[1", "$['a'", "$[a]", "$[1:2,3]", "$['a',b]", "$['a',xbx]", "$[?(@.a]", "$[?()]", "$[?(@.a == )]", "$[?(@.a)", "$[?@.a]", "$[99999999999]", "$[0,]", "$.a["])
def test_errors(path):
    with pytest.raises(PathError) as e:
        parse(path)
    assert e.value.path == path
    assert 0 <= e.value.position <= len(path)


@pytest.mark.parametrize("path", ["$", "$.a.b", "$['x.y']", "$[0][-1]", "$[1:3]", "$[::-2]", "$.*", "$..a", "$..*", "$..[2]", "$[0,2]", "$['a','b']", "$[(@.length-1)]", "$[?(@.a)]", "$[?(@.a < 1.5)]", "$[?((@.a || @.b))]", "$[?(!@.a == 'x')]"])
def test_canonical_text_reads_back(path):
    assert text(parse(path)) == path
    assert parse(text(parse(path))) == parse(path)


def test_wildcards_have_one_text():
    assert text(parse("$.a[*]")) == "$.a.*"
