import json

import pytest

from docsieve import QueryError, format_output
from docsieve.cli import main, session
from docsieve.cli import arguments
from docsieve.complete import complete
from docsieve.sources.formats import detect, parse, sniff


@pytest.mark.parametrize("path,fmt", [("A.JSON", "json"), ("a.yml", "yaml"), ("a.tf", "hcl"), ("pom.pom", "xml"), ("x.tab", "tsv"), ("x.markdown", "markdown"), ("x", None)])
def test_detect(path, fmt):
    assert detect(path) == fmt


@pytest.mark.parametrize("text,fmt", [('{"a":1}', "json"), ("<a/>", "xml"), ("---\na: 1", "yaml"), ("a: 1", "yaml"), ("a = 1", "toml"), ("a = {}", "hcl"), ("# T", "markdown"), ("- x", "markdown"), ("", "json"), ("# T: x", "yaml")])
def test_sniff(text, fmt):
    assert sniff(text) == fmt


def test_yaml_toml():
    assert parse("name: Alice\npi: 3.14\nnotes: null\nd: {host: h, port: 5432}", "yaml") == {"name": "Alice", "pi": 3.14, "notes": None, "d": {"host": "h", "port": 5432}}
    assert parse('[database]\nhost = "h"\nports = [1, 2]\nenabled = true\nat = 2020-01-02', "toml") == {"database": {"host": "h", "ports": [1, 2], "enabled": True, "at": "2020-01-02"}}


def test_hcl():
    text = 'region = "eu"\nresource "aws_instance" "web" {\n  ami = "abc"\n  tags = { Name = "x", n = 1 }\n  l = [1, 2]\n  e = var.x + 1\n}\n# c\nvariable "a" {}\nvariable "b" {\n}\n'
    assert parse(text, "hcl") == {
        "region": "eu", "resource": {"_labels": ["aws_instance", "web"], "ami": "abc", "tags": {"Name": "x", "n": 1}, "l": [1, 2], "e": "var.x + 1"},
        "variable": [{"_labels": ["a"]}, {"_labels": ["b"]}],
    }


def test_xml_csv():
    assert parse('<p id="1"><n>x</n><d>a</d><d>b</d><e/></p>', "xml") == {"p": {"@id": "1", "n": "x", "d": ["a", "b"], "e": None}}
    assert parse('name,age\n"A, B",3\nC\n', "csv") == [{"name": "A, B", "age": "3"}, {"name": "C"}]
    assert parse("1,2\n3,4\n", "csv") == [["1", "2"], ["3", "4"]]
    assert parse("a\tb\n1\t2\n", "tsv") == [{"a": "1", "b": "2"}]


def test_markdown():
    doc = parse("# Hi *you*\n\ntext [l](http://x \"t\") `c` ![alt](i.png)  \nnext\n\n- a\n- b\n\n1. x\n\n> q\n\n```py\nprint()\n```\n\n---\n<div>x</div>\n", "markdown")
    kinds = [c["type"] for c in doc["children"]]
    assert kinds == ["heading", "paragraph", "list", "list", "blockquote", "code_block", "thematic_break", "html_block"]
    assert doc["children"][0] == {"type": "heading", "level": 1, "children": [{"type": "text", "text": "Hi "}, {"type": "emphasis", "children": [{"type": "text", "text": "you"}]}]}
    para = doc["children"][1]["children"]
    assert [c["type"] for c in para] == ["text", "link", "text", "code", "text", "image", "hard_break", "text"]
    assert para[1]["href"] == "http://x" and para[1]["title"] == "t" and para[5] == {"type": "image", "src": "i.png", "alt": "alt"}
    assert doc["children"][2]["ordered"] is False and doc["children"][2]["tight"] and doc["children"][3]["start"] == 1
    assert doc["children"][5] == {"type": "code_block", "language": "py", "code": "print()\n"}
    assert parse("", "markdown") == {"type": "document", "children": []}


@pytest.mark.parametrize("fmt", ["yaml", "toml", "hcl", "json"])
def test_round_trip(fmt):
    v = {"a": 1, "b": "x\"y", "c": [1, 2], "d": {"e": True, "f": 1.5}}
    assert parse(format_output(v, fmt), fmt) == v


def test_outputs():
    assert format_output([{"a": 1, "b": None}, {"a": "x,y"}], "csv") == 'a,b\n1,\n"x,y",\n'
    assert format_output([[1, None]], "tsv") == "1\tnull\n"
    assert format_output([], "csv") == "" and format_output([1, 2], "csv") == "1\n2\n"
    assert parse(format_output({"r": {"@i": "1", "x": ["a", "b"]}}, "xml"), "xml") == {"r": {"@i": "1", "x": ["a", "b"]}}
    assert format_output({"a": 1}, "json", False) == '{"a":1}'
    for fmt in ("toml", "hcl"):
        with pytest.raises(QueryError):
            format_output([1], fmt)
    with pytest.raises(QueryError):
        format_output({"a": 1}, "csv")
    with pytest.raises(QueryError):
        format_output(float("inf"))


def test_bad_input():
    for text, fmt in (("{", "json"), ("a = ", "toml"), ("<a>", "xml"), ("a: [", "yaml"), ("a = {", "hcl")):
        with pytest.raises(QueryError):
            parse(text, fmt)


def test_command_line(tmp_path, capsys):
    f = tmp_path / "d.json"
    f.write_text(json.dumps({"a": [1, 2], "s": "x", "t": True}))
    assert main([".s", str(f), "-r"]) == 0 and capsys.readouterr().out == "x\n"
    assert main(["--schema", str(f)]) == 0 and json.loads(capsys.readouterr().out)["a"] == ["number"]
    assert main(["--assert", ".t", str(f)]) == 0 and main(["--assert", ".a | length > 5", str(f)]) == 1
    assert main([".a | nope", str(f)]) == 1
    assert main([".", str(f), "-t", "yaml"]) == 0


def test_session(tmp_path):
    lines, shown = iter([":help", ":schema", ". | length", ":to yaml", ".", ":raw", ":bad", ". | x", ":history", ":q"]), []
    assert session(list(range(12)), arguments().parse_args([]), lambda _: next(lines), shown.append) == 0
    assert "12" in shown and any("unknown command" in s for s in shown) and any("unknown operation" in s for s in shown)


DATA = {"users": [{"name": "A", "age": 1, "at": {"city": "x", "zip": 1}}], "version": 1, "scores": {"a": {"total": 1}}}
OPERATIONS = 24


@pytest.mark.parametrize(
    "text,start,found",
    [
        (".", 0, [".scores", ".users", ".version"]), (".u", 0, [".users"]), (".users[0].n", 9, [".name"]), (".version.", 8, []), (".xyz", 0, []), ("", 0, []),
        (".users | fi", 9, ["filter", "filter_keys", "filter_values", "first"]), (".users | zz", 9, []), (".users | unique_", 9, ["unique_by"]),
        (".users | map(.", 13, [".age", ".at", ".name"]), (".users | filter(.at.ci", 19, [".city"]), (".users | sort_by(.name) | filter(.a", 33, [".age", ".at"]),
        (".users | filter(.age > 20 && .na", 29, [".name"]), (".version | filter(.", 18, []), (".scores | filter_values(.to", 24, [".total"]),
        ("if true then .us", 13, [".users"]), ("if true then .name else .ver", 24, [".version"]), ('"hello \\(.us', 9, [".users"]),
        ('.users | map(.name + " | ") | fil', 30, ["filter", "filter_keys", "filter_values"]), ('.users | map("a|s', 16, []), (".users | filter(.age > 30)", 26, []), (".users[", 7, []),
        (":sch", 1, ["schema"]), (":q", 1, ["q", "quit"]), (":to y", 4, ["yaml"]), (":to z", 4, []),
    ],
)
def test_complete(text, start, found):
    assert complete(text, len(text), DATA) == (start, found)


def test_complete_all():
    assert len(complete(".users | ", 9, DATA)[1]) == OPERATIONS and len(complete(":", 1, None)[1]) == 9
    assert len(complete('.users | filter(.name != "a|b") | ', 34, DATA)[1]) == OPERATIONS


def test_session_joins_lines():
    lines, shown = iter([". | map(", "  .a", ")"]), []

    def read(_):
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    assert session([{"a": 1}], arguments().parse_args(["-t", "csv"]), read, shown.append) == 0 and shown == ["1"]


def test_yaml_core_schema():
    text = "a: no\nb: on\nc: 012\nd: 0o14\ne: 0x1F\nf: 2020-01-02\ng: True\nh: 1e3\ni: .5\nj: -.inf\nk: ~\nl:\nm: 1_000\nn: 12:30:45\no: '1'\n"
    assert parse(text, "yaml") == {
        "a": "no", "b": "on", "c": 12, "d": 12, "e": 31, "f": "2020-01-02", "g": True, "h": 1000.0, "i": 0.5, "j": float("-inf"), "k": None, "l": None, "m": "1_000", "n": "12:30:45", "o": "1",
    }
    odd = {"a": "no", "b": "0o14", "c": "1e3", "d": "null", "e": "", "f": "~", "g": "012", "h": ".5"}
    assert parse(format_output(odd, "yaml"), "yaml") == odd


def test_markdown_references():
    doc = parse("see [the text][A  b], [a B][] and [c]; ![pic][c] not [d]\n\n[a b]: <http://x/y> \"T\"\n[C]: /z\n[c]: /other\n\n```\n[d]: /no\n```\n", "markdown")
    para = doc["children"][0]["children"]
    assert [(n["href"], n.get("title")) for n in para if n["type"] == "link"] == [("http://x/y", "T"), ("http://x/y", "T"), ("/z", None)]
    assert [n for n in para if n["type"] == "image"] == [{"type": "image", "src": "/z", "alt": "pic"}] and para[-1]["text"] == " not [d]"
    assert [c["type"] for c in doc["children"]] == ["paragraph", "code_block"] and doc["children"][1]["code"] == "[d]: /no\n"
