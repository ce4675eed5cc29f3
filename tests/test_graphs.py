"""The parser and what follows from its trees: goldens and brute force."""

import itertools
import random

import pytest

from korvine.operators import cparse as C

CODE = """int copy(char *src, int n) {
    char buf[16];
    char *q = malloc(n);
    if (q == NULL) {
        return -1;
    }
    for (int i = 0; i < n; i++) {
        buf[i] = src[i];
        if (i == 7) break;
    }
    strcpy(buf, src);
    free(q);
    return q->len + 0x1F;
}
"""


def kinds(code):
    return [n.kind for n, _, _ in C.walk(C.parse(code))]


def test_kinds():
    assert kinds("x = (char *)p + f(a, b[1])->c;") == ["translation_unit", "expression_statement", "assignment_expression", "identifier", "binary_expression", "cast_expression", "type_descriptor", "type_identifier", "abstract_pointer_declarator", "identifier", "field_expression", "call_expression", "identifier", "argument_list", "identifier", "subscript_expression", "identifier", "number_literal", "field_identifier"]
    assert "declaration" in kinds("foo *p = q;") and "declaration" not in kinds("a * b + c;")
    assert C.parse(" \n") is None
    assert kinds("struct s { int a; } x;").count("declaration") == 2
    assert "conditional_expression" in kinds("y = a ? b : c;") and "update_expression" in kinds("++i;") and "sizeof_expression" in kinds("n = sizeof(int);")


def test_binding():
    t = C.parse("a + b * c - d;").children[0].children[0]
    code = "a + b * c - d;"
    assert [code[c.start : c.end] for c in t.children] == ["a + b * c", "d"]


@pytest.mark.parametrize("code", ["int f( {", "}}}", "if if if", "((((", "a b c d", "switch (x) { case", "for (;;", "do", "x = ;", "f(,);", '"', "int f() { return }", "{" * 3000, "(" * 3000, "a = " * 3000, "if (x) " * 3000])
def test_anything_parses(code):
    spans = [(n.start, n.end) for n, _, _ in C.walk(C.parse(code))]
    assert all(0 <= s <= e <= len(code) for s, e in spans)
    C.control_flow(code, C.parse(code))
    C.graph_slice(code, [1], "both")


def test_random_tokens_parse():
    rng = random.Random(4)
    words = ["if", "else", "while", "for", "do", "switch", "case", "default", "return", "break", "goto", "int", "char", "a", "b", "(", ")", "{", "}", ";", ",", "*", "&", "=", "+", "[", "]", "->", "1", ":", "?", "sizeof"]
    for _ in range(400):
        code = " ".join(rng.choice(words) for _ in range(rng.randrange(60)))
        root = C.parse(code)
        if root:
            for n, _, _ in C.walk(root):
                assert all(n.start <= c.start and c.end <= max(n.end, c.start) for c in n.children) or n.kind == "translation_unit"
            C.post_dominators(C.control_flow(code, root))


def test_flow():
    f = C.control_flow(CODE, C.parse(CODE))
    by_line = {}
    for k, (s, _, kind, _) in enumerate(f.blocks):
        by_line.setdefault(s, []).append((k, kind))
    assert [k for _, k in by_line[4]] == ["condition"] and [k for _, k in by_line[7]] == ["loop_header"]
    edges = {(f.blocks[a][0], f.blocks[b][0], t) for a, b, t in f.edges}
    assert {(4, 5, "TRUE_BRANCH"), (4, 7, "FALSE_BRANCH"), (5, 14, "RETURN"), (7, 8, "TRUE_BRANCH"), (7, 11, "LOOP_EXIT"), (9, 7, "FALSE_BRANCH"), (9, 11, "BREAK"), (13, 14, "RETURN")} <= edges


def test_switch_goto_and_do():
    code = "void f(int n) {\nswitch (n) {\ncase 1:\nn = 2;\ncase 2:\nbreak;\ndefault:\ngoto out;\n}\ndo {\nn--;\n} while (n);\nout:\nn = 0;\n}"
    f = C.control_flow(code, C.parse(code))
    edges = {(f.blocks[a][0], f.blocks[b][0], t) for a, b, t in f.edges}
    assert {(2, 3, "SWITCH_CASE"), (2, 5, "SWITCH_CASE"), (2, 7, "SWITCH_DEFAULT"), (4, 5, "SEQUENTIAL"), (6, 11, "BREAK"), (8, 13, "GOTO"), (12, 11, "LOOP_BACK"), (12, 13, "LOOP_EXIT")} <= edges


def _brute_post(flow):
    """Sets of post-dominators from their definition: blocks without which the exit is out of reach."""
    succ = {}
    for a, b, _ in flow.edges:
        succ.setdefault(a, set()).add(b)

    def reaches(start, without):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x == without or x in seen:
                continue
            seen.add(x)
            todo += succ.get(x, ())
        return 1 in seen

    n = len(flow.blocks)
    return {b: {d for d in range(n) if d != b and reaches(b, None) and not reaches(b, d)} for b in range(n)}


def test_post_dominators_by_definition():
    rng = random.Random(7)
    codes = [CODE]
    for _ in range(60):
        def body(depth):
            out = []
            for _ in range(rng.randrange(1, 4)):
                inner = lambda: body(depth + 1)
                forms = [lambda: "x = x + 1;", lambda: "if (x) return 1;", lambda: "if (x) {\n" + inner() + "}", lambda: "if (x) {\n" + inner() + "} else {\n" + inner() + "}", lambda: "while (x) {\n" + inner() + "}", lambda: "do {\n" + inner() + "} while (x);", lambda: "for (;;) { if (y) break; " + inner() + "}"]
                out.append(forms[rng.randrange(7 if depth < 3 else 2)]())
            return "\n".join(out) + "\n"

        codes.append("int f(int x) {\n" + body(0) + "return x;\n}")
    for code in codes:
        flow = C.control_flow(code, C.parse(code))
        got, want = C.post_dominators(flow), _brute_post(flow)
        for b, ip in enumerate(got):
            chain, x = set(), ip
            while x >= 0:
                chain.add(x)
                x = got[x]
            if want[b] or ip >= 0:
                assert chain == want[b], (code, b)


def test_data_edges_by_brute_force():
    found = C.accesses(CODE, C.parse(CODE))
    edges = set(C.data_edges(found))
    for k, (name, line, pos, kind, _) in enumerate(found):
        if kind not in ("def", "param"):
            defs = [j for j in range(k) if found[j][0] == name and found[j][3] in ("def", "param")]
            assert {a for a, b, t in edges if b == k and t == "def-use"} == ({max(defs)} if defs else set())
    code = "int f(int x) {\nx = x + 1;\nint *p = &x;\nreturn *p;\n}"
    found = C.accesses(code, C.parse(code))
    flows = {(found[a][0], found[a][1], found[b][0], found[b][1], t) for a, b, t in C.data_edges(found)}
    assert ("x", 1, "x", 2, "def-use") in flows and ("x", 2, "x", 3, "def-use") in flows and ("x", 3, "p", 4, "ptr-flow") in flows and ("x", 2, "x", 2, "def-use") not in flows


def test_slices():
    assert C.graph_slice(CODE, [12], "backward") == [1, 3, 4, 7, 9, 12]
    forward = C.graph_slice(CODE, [3], "forward")
    assert {3, 4, 5, 12, 13} <= set(forward)
    both = C.graph_slice(CODE, [3], "both")
    assert set(both) == set(forward) | set(C.graph_slice(CODE, [3], "backward"))
    assert C.graph_slice("", [3], "backward") == [3]


def test_def_use_in_frames_equals_python(spark):
    """The window form of def-use and the join form of ptr-flow, against the plain functions."""
    from korvine.operators import graphs

    codes = [CODE, "int f(int x) {\nx = x + 1;\nint *p = &x;\nreturn *p;\n}", "", "a = b; b = a; a = a + b; c(&a, *b); *b = 1;"]
    d = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    from pyspark.sql import functions as F

    a = d.select("id", graphs.c_graph("code").alias("g")).select("id", F.inline("g.accesses"))
    got = {tuple(r) for r in graphs.definitions_of_uses(a).collect()}
    want = {(i, x, y, t) for i, c in enumerate(codes) for x, y, t in C.data_edges(C.accesses(c, C.parse(c)))}
    assert got == want


def test_registered_names(spark):
    from korvine.session import register

    register(spark)
    assert spark.sql("SELECT size(c_tokens('a = 1;')), size(c_parse('a = 1;')), c_blanked('a /* b */ c'), c_slice('a = 1;\nb = a;', array(2), 'backward')").first()[:3] == (4, 5, "a         c")


def test_streams_score_as_tables_do(spark, tmp_path):
    import json

    from korvine import streaming
    from korvine.settings import Settings

    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"id": k, "func": f"strcpy(a, b); free(p{k});", "target": False, "project": "x", "split": "train"} for k in range(20)] + [{"id": 99, "func": None}]
    for k, part in enumerate(itertools.batched(rows, 7)):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
    s = streaming.read_stream(spark, str(folder), 1)
    streaming.write_scores(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, streaming.scored(spark.createDataFrame([(r["id"], r["func"]) for r in rows], "id long, func string")).collect()))
    assert got == want and len(got) == 21
    streaming.write_vectors(s, {"strcpy": 7, "VAR_0": 8}, str(tmp_path / "vec"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "vec")).count() == 21
    assert Settings.load("min_freq: 3\nunknown: 1").min_freq == 3 and Settings.load(Settings().dump()) == Settings()


def test_readers(spark, tmp_path):
    from korvine.sources import corpus

    d = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "id long, func string, split string")
    corpus.write_shards(d, str(tmp_path / "s"))
    assert [r.id for r in corpus.read_functions(spark, str(tmp_path / "s"), "train", ["id"]).collect()] == [1]
    assert {(r.id, r.split) for r in corpus.read_functions(spark, str(tmp_path / "s")).collect()} == {(1, "train"), (2, "test")}
    with pytest.raises(ValueError):
        corpus.read_functions(spark, str(tmp_path / "s"), "dev")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "val.jsonl").write_text('{"id": 3}\n\n{"id": 4}\n')
    assert corpus.read_any(spark, str(tmp_path / "j"), "valid").where("id IS NOT NULL").count() == 2
    with pytest.raises(FileNotFoundError):
        corpus.read_any(spark, str(tmp_path / "j"), "test")
