"""Queries that read each text once: against brute force, and without joins or second passes in their plans."""

import pytest

from korvine.operators import cparse as C, places
from korvine.plans import registry

from .test_graphs import CODE
from .test_queries import _corpus

SF = "/root/testdata/sf0.001"
CODES = [CODE, "", "\n", "int f(int x) {\nx = x + 1;\nint *p = &x;\nreturn *p;\n}", "/* malloc */ a[i] = *b;\nstrcpy(a, b); free(p)->q(r);", "((((", "int f() {\n" + "x = malloc(3);\n" * 30 + "}"]


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("row", [0, 7, 123456789012, -1000])
def test_line_scores(row):
    code = "a b\n\nc = 1; d\n" + "n = n + 1;\n" * 300
    t = places.lined(code)
    rest = lambda a, n: abs(a) % n * (1 if a >= 0 else -1)
    w = [2 * rest(i * 13 + row, 7) + (rest(i // 32 * 5 + row, 3) + rest(i // 32 * 3 + row, 4)) * rest(i * 17 + row, 5) for i in range(len(t))]
    want = [(x, sum(a for a, (_, line) in zip(w, t) if line == x), " ".join([k for a, (k, line) in zip(w, t) if line == x and 1000 * a > sum(w)][:10])) for x in dict.fromkeys(line for _, line in t)]
    assert places.line_scores(code, row) == want


def test_line_scores_read_tokens_once(spark):
    """No lambda goes through all tokens for each line."""
    assert "filter(" not in plan(spark, "a20_line_scores")


def test_highlights_read_tokens_once(spark):
    assert "filter(" not in plan(spark, "m9_highlights")


def test_nodes_over_lines_in_one_pass(spark):
    for code in CODES:
        lines = list(range(1, code.count("\n") + 2))
        want = []
        for x in lines:
            over = [n for n in C.nodes(code) if n[1] not in ("comment", "ERROR") and n[3] <= x <= n[5]]
            whole = [(n[7] - n[6], n[0], n[1]) for n in over if n[8] >= 0 and ("statement" in n[1] or n[1].endswith("declaration"))]
            want += [(x, len(over), min(whole)[2] if whole else None)] if over else []
        assert C.nodes_over(code, lines) == want
    assert "Join" not in plan(spark, "g19_nodes_of_lines")


def test_called_names_of_rows_without_id(spark, monkeypatch):
    """Grouped by id as in SQL: null is a group, and rows of the same id count together, not each with each."""
    _corpus(monkeypatch, spark, [(None, "f(a); g(f(b)); x.h(c);", ""), (1, "k(1);", ""), (1, "k(2); if (x) k(3);", "")])
    assert {tuple(r) for r in registry.queries()["g3_called_names"](spark, "").collect()} == {(None, "f", 2), (None, "g", 1), (1, "k", 3)}


def test_dependency_slices_in_one_pass(spark):
    sinks, memory = ["strcpy"], ["malloc", "free"]
    for code in CODES:
        nodes, prio = C.nodes(code), {}
        for n in nodes:
            callee = next((k[2] for k in nodes if k[1] == "identifier" and k[8] == n[0] and k[0] == n[0] + 1), None)
            p = 3 if n[1] in ("pointer_expression", "subscript_expression") else 1 if n[1] == "call_expression" and callee in sinks else 2 if n[1] == "call_expression" and callee in memory else None
            if p:
                prio.setdefault(n[3], []).append(p)
        seeds = [x for _, x in sorted((min(p), x) for x, p in prio.items())][:6]
        wanted = ([("backward", x) for x in seeds] + [("forward", x) for x in seeds] + [("even", x) for x in range(6)])[:6]
        lines = lambda k, x: [i for i in range(1, code.count("\n") + 2) if (i - 1) // 20 == x] if k == "even" else C.graph_slice(code, [x], k)  # noqa: E731, B023
        assert C.dependency_slices(code, frozenset(sinks), frozenset(memory)) == [(i, k, x, lines(k, x)) for i, (k, x) in enumerate(wanted)]
    assert "Join" not in plan(spark, "g18_dependency_slices")


def test_risk_parses_once(spark):
    p = plan(spark, "g17_graph_risk")
    assert "Join" not in p and p.count("ArrowEvalPython") == 1


def test_data_edges_in_one_pass(spark, monkeypatch):
    _corpus(monkeypatch, spark, [(k, c, "") for k, c in enumerate(CODES)])
    got = sorted(map(tuple, registry.queries()["g8_data_edges"](spark, "").collect()))
    assert got == sorted((i, *e) for i, c in enumerate(CODES) for e in C.data_edges(C.accesses(c, C.parse(c)))) and got
    assert "Join" not in registry.queries()["g8_data_edges"](spark, "")._jdf.queryExecution().optimizedPlan().toString()


def test_learned_maps():
    pairs = [("f", "FUNC_0"), ("a", "VAR_0"), ("a", "VAR_0"), ("a", "FUNC_1"), ("+", "+"), ("b", "VAR_1")]
    assert places.learned(pairs, 10) == [("VAR", "a", "VAR_10", 12), ("VAR", "b", "VAR_11", 12), ("FUNC", "f", "FUNC_10", 12), ("FUNC", "a", "FUNC_11", 12)]
    assert places.learned(pairs, None) == [] == places.learned([], 3)


def test_learned_maps_read_tokens_once(spark):
    assert "filter(" not in plan(spark, "n6_learned_maps")


def test_model_counts_features_once(spark):
    """What is scored comes from the written features; no pattern runs again."""
    p = plan(spark, "m10a_feature_model")
    assert "Join" not in p and "RLIKE" not in p and "regexp" not in p


def test_line_dedup_with_colliding_keys(spark, monkeypatch):
    """Index keys have zeros in their first bytes; with six bits left, all lines collide and the results stay."""
    from korvine.llm import line_dedup

    base = ["the quick brown fox jumps over the lazy dog", "a line of some other words that stays", "short line of text", "nothing like the rest of these lines here", "", "x"]
    edited = lambda t, k: t[:k] + "#" + t[k + 1 :]
    rows = [(k, "\n".join([*base[k % 3 :], edited(base[0], k % 40), edited(base[1], 30 - k)])) for k in range(12)]
    docs = spark.createDataFrame([*rows, (12, None)], "doc_id long, text string")
    assert line_dedup._rows(docs.selectExpr("explode(split(text, '\n')) AS line").where("length(line) > 15").selectExpr("line", "xxhash64(line) AS h"), 2, True, True).where("k & 16777215 <> 0").count() == 0
    result = lambda: sorted(map(str, line_dedup.rewritten(docs).collect()))
    want = result()
    monkeypatch.setattr(line_dedup, "KEY_BITS", -1 << 58)
    assert result() == want and any("n_near=1" in x or "n_near=2" in x for x in want)
