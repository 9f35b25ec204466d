import pytest

from fathomlab.errors import DependencyError, PluginError
from fathomlab.plans.plugins import Plugin, Plugins, rule_id


def make(i, provides=(), requires=(), **more):
    return Plugin(i, "1.0.0", "feature", lambda bars, **c: bars, tuple(provides), tuple(requires), **more)


def test_order_and_errors():
    p = Plugins()
    p.add(make("zeta", ["z.a"]))
    p.add(make("alpha", ["a.a"], ["z.a"]))
    p.add(make("beta", ["b.a"]))
    assert [x.id for x in p.ordered()] == ["beta", "zeta", "alpha"] and len(p.version()) == 16
    with pytest.raises(PluginError):
        p.add(make("gamma", ["z.a"]))
    p.remove("zeta")
    with pytest.raises(DependencyError):
        p.ordered()
    p.add(make("zeta", ["z.a"], ["a.a"]))
    with pytest.raises(DependencyError, match="cycle"):
        p.ordered()
    a = make("alpha")
    assert rule_id(a, {"x": 1}) != rule_id(a, {"x": 2}) and rule_id(a, {"x": 1, "y": 2}) == rule_id(a, {"y": 2, "x": 1})


def test_switching_and_loading():
    from fathomlab.plans.builtin import load

    p = Plugins()
    p.add(make("zeta", ["z.a"]))
    p.add(make("alpha", ["a.a"], ["z.a"]))
    p.enable("zeta", False)
    with pytest.raises(DependencyError, match="disabled"):
        p.ordered()
    with pytest.raises(PluginError):
        p.add(make("other", ["z.a"]))
    p.enable("zeta")
    build = lambda bars, **config: bars
    manifest = {"version": "1.0.0", "kind": "feature"}
    failed = load(p, [{"id": "beta", "provides": ["b.a"], **manifest}, {"id": "gone", "provides": ["g.a"], **manifest}, {"id": "off", "provides": ["o.a"], "enabled": False, **manifest}], {"beta": build})
    assert list(failed) == ["gone"] and [x.id for x in p.ordered()] == ["beta", "zeta", "alpha"]
    with pytest.raises(PluginError):
        load(Plugins(), [{"id": "gone", **manifest}], {}, tolerant=False)


def test_manifests_of_a_folder(spark, tmp_path):
    from fathomlab.plans.builtin import discover_manifests, installed

    for name, text in (("a", '{"id":"core-a","version":"1.0.0","kind":"feature","provides":["a.x"],"config":{"n":"14","m":"1"}}'), ("b", '{"id":"b","version":"1","kind":"entry"}'), ("c", "no json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "plugin.json").write_text(text)
    found = discover_manifests(spark, str(tmp_path))
    assert sorted(str(r["error"]) for r in found.collect()) == ["None", "bad version", "not a manifest"]
    set_ = spark.createDataFrame([("core-a", False, {"n": "20"})], "id string, enabled boolean, config map<string,string>")
    (row,) = installed(found, set_).collect()
    assert row["enabled"] is False and row["config"] == {"n": "20", "m": "1"}
