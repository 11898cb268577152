"""Star re-exports: shadowing, ambiguity, diamonds, chains and loops. The cases stand in one table, each with module names of its own."""

import pytest

from tessera.operators import graph, reexports


def star(module, source, pos=0, rebinds=False, exported=True, only=None):
    return (module, pos, "*", "reexport", source, None, True, rebinds, exported, only)


def own(module, name, pos=0, kind="function", exported=True):
    return (module, pos, name, kind, None, None, False, False, exported, None)


def named(module, name, source, pos=0, symbol=None, kind="reexport"):
    return (module, pos, name, kind, source, symbol, False, False, True, None)


def diamond(depth, rebinds):
    inner = [star(f"l{k}_{side}", f"l{k + 1}_{t}", t, rebinds) for k in range(depth - 1) for side in range(2) for t in range(2)]
    return [*inner, *[own(f"l{depth - 1}_{side}", f"x{side}") for side in range(2)]]


def ring(n):
    return [r for i in range(n) for r in (own(f"m{i}", f"x{i}"), star(f"m{i}", f"m{(i + 1) % n}", 1))]


LIMITED = [own("a", "xa"), star("a", "b", 1), own("b", "xb"), star("b", "c", 1, only=["xc"]), own("c", "xc"), own("c", "xd", 1), star("c", "a", 2)]
SUBMODULES = [
    named("q", "sub", "pkg"), own("pkg", "x"), own("pkg.sub", "z"), star("q", "dark", 1), star("r", "q"), own("dark", "w"), own("hid", "h", exported=False), star("r", "hid", 1),
    star("pkg", "open", 1, exported=None), own("open", "o"), star("t", "pkg"),
]
CASES = {
    "diamond": diamond(7, False), "late diamond": diamond(5, True), "ring": ring(6), "limited": LIMITED, "submodules": SUBMODULES,
    "returns": [star("a", "b"), star("a", "c", 1), star("b", "a"), own("b", "y", 1), own("c", "x")],
    "late returns": [star("a", "c", 0, True), star("a", "b", 1, True), star("b", "a", 0, True), own("b", "y", 1), own("c", "x")],
    "hidden": [own("m", "x"), star("m", "s", 1), own("s", "x"), own("s", "y", 1)],
    "replaced": [own("m", "x"), star("m", "s", 1, True), own("s", "x")],
    "kept": [star("m", "s", 0, True), own("m", "x", 1), own("s", "x")],
    "ambiguous": [star("m", "a"), star("m", "b", 1), own("a", "x"), own("b", "x"), star("top", "m")],
    "one by two ways": [star("k", "c"), star("k", "d", 1), star("c", "e"), star("d", "e"), own("e", "z")],
    "nowhere": [named("a", "y", "b"), named("b", "y", "a"), named("c", "gone", "outside"), named("c", "miss", "d", 1), own("d", "here"), named("c", "as_here", "d", 2, "here"), named("c", "space", "d", 3, kind="module")],
    "empty loop": [star("a", "b"), star("b", "a"), star("m", "a"), own("m", "x", 1)],
}


def resolve(spark, records, unread=(), packages=None):
    modules = {r[0] for r in records} | set(packages or ())
    table = spark.createDataFrame([(m, (packages or {}).get(m, "p"), m not in unread) for m in sorted(modules)], "module string, package string, parsed boolean")
    return reexports.resolve(spark.createDataFrame(records, reexports.RECORDS), table)


@pytest.fixture(scope="module")
def cases(spark):
    at = lambda case, m: None if m is None else f"{case}/{m}"
    records = [(at(case, r[0]), *r[1:4], at(case, r[4]), *r[5:]) for case, own in CASES.items() for r in own]
    packages = {at("submodules", m): at("submodules", p) for m, p in (("q", "q"), ("pkg", "pkg"), ("pkg.sub", "pkg"))}
    names, problems = resolve(spark, records, {"submodules/dark"}, packages)
    bare = lambda m: m and m.split("/", 1)[1]
    found, said = {c: {} for c in CASES}, {c: [] for c in CASES}
    for r in names.collect():
        found[r.module.split("/")[0]][bare(r.module), r.name] = (r.kind, bare(r.reexport_of), bare(r.defined_in), r.defined_as, r.ambiguous)
    for r in problems.collect():
        said[r.module.split("/")[0]].append((bare(r.module), r.reason))
    return found, said


def where(found, module):
    return {n: v[2] for (m, n), v in found.items() if m == module}


def test_a_diamond_resolves_by_its_edges(cases):
    found, problems = cases
    assert where(found["diamond"], "l0_0") == {"x0": "l6_0", "x1": "l6_1"} and problems["diamond"] == []
    assert where(found["late diamond"], "l0_0") == {"x0": "l4_0", "x1": "l4_1"} and problems["late diamond"] == []


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    real = graph.cut
    for place in (graph, reexports):
        monkeypatch.setattr(place, "cut", lambda df: rounds.append(1) or real(df))
    names, problems = resolve(spark, [star(f"p.m{i}", f"p.m{i + 1}") for i in range(n - 1)] + [own(f"p.m{n - 1}", "x")])
    found = {r.module: r for r in names.collect()}
    assert len(found) == n and all(r.defined_in == f"p.m{n - 1}" and r.defined_as == "x" for r in found.values())
    assert found["p.m0"].reexport_of == "p.m1" and found["p.m0"].kind == "function" and problems.isEmpty() and len(rounds) < 80


def test_a_loop_gives_each_module_all_names(cases):
    found, problems = cases
    for i in range(6):
        assert where(found["ring"], f"m{i}") == {f"x{k}": f"m{k}" for k in range(6)}
    assert problems["ring"] == problems["empty loop"] == [] and set(found["empty loop"]) == {("m", "x")}


def test_a_limited_record_in_a_loop_limits_what_passes(cases):
    found = cases[0]["limited"]
    assert where(found, "a") == {"xa": "a", "xb": "b", "xc": "c"}
    assert where(found, "b") == where(found, "c") == {"xa": "a", "xb": "b", "xc": "c", "xd": "c"}


def test_names_do_not_come_back_through_their_own_module(cases):
    """b brings nothing of its own from c to a: it has it from a."""
    found, problems = cases
    assert found["returns"]["a", "x"][1:3] == ("c", "c") and found["returns"]["b", "x"][1:3] == ("a", "c") and problems["returns"] == []
    assert found["late returns"]["a", "x"][1:3] == ("c", "c")


def test_own_names_hide_star_names_unless_a_later_binding_replaces_them(cases):
    found = cases[0]
    assert where(found["hidden"], "m") == {"x": "m", "y": "s"} and where(found["replaced"], "m") == {"x": "s"} and where(found["kept"], "m") == {"x": "m"}


def test_two_definitions_are_ambiguous_and_one_by_two_ways_is_not(cases):
    found, problems = cases
    assert found["ambiguous"]["m", "x"] == ("unknown", "a", None, None, True) and found["ambiguous"]["top", "x"][0] == "unknown"
    assert found["one by two ways"]["k", "z"][2:] == ("e", "z", False)
    assert problems["ambiguous"] == [("m", "ambiguous star export x")] and problems["one by two ways"] == []


def test_links_that_end_nowhere(cases):
    found = cases[0]["nowhere"]
    assert [found[k][0] for k in (("a", "y"), ("b", "y"), ("c", "gone"), ("c", "miss"))] == ["unknown"] * 4
    assert found["c", "as_here"][:4] == ("function", "d", "d", "here") and found["c", "space"][:4] == ("module", "d", "d", "*")


def test_submodules_and_modules_that_were_not_read(cases):
    found, problems = cases[0]["submodules"], cases[1]["submodules"]
    assert found["q", "sub"][:4] == ("module", "pkg.sub", "pkg.sub", "*")
    assert where(found, "r") == {"sub": "pkg.sub"} and where(found, "pkg") == {"x": "pkg", "o": "open"} and where(found, "t") == {"x": "pkg"}
    assert sorted(m for m, _ in problems) == ["q", "r", "t"]


def test_nothing_to_resolve(spark):
    names, problems = resolve(spark, [own("a", "x")][:0], packages={"lone": "p"})
    assert names.isEmpty() and problems.isEmpty()
