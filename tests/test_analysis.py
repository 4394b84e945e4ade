"""The analysis from hand-written facts to assets, the sources beside it, and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.plans import analysis
from factloom.sources import facts as model
from factloom.sources import manifests, sinks
from factloom.streaming import events

CRATE = {"name": "app", "stable_id": "1", "package": "app", "version": "0.1.0", "cwd": "/ws", "unit": "app-1"}


def crate(name):
    return {"name": name, "stable_id": "9"}


def owner(name):
    return {"kind": "Fn", "name": name, "id": name, "krate": crate("app"), "path": name}


def loc(line, col=5):
    return {"file": "src/main.rs", "line": line, "col": col, "end_line": line, "end_col": col + 3}


def call(path, krate, line, who, tier="Present", self_ty=None, args=()):
    target = {"Call": {"callee": {"krate": crate(krate), "path": path, "id": path}, "method": path.split("::")[-1], "self_ty": self_ty, "args": list(args), "const_args": [None, "170141183460469231731687303715884105727"], "arg_origins": [{"Const": {"value": 1}}], "arg_lens": [18446744073709551615]}}
    return {"tier": tier, "owner": owner(who), "span": loc(line), "target": target, "via": [], "expansion": None}


AES = {"Adt": {"krate": crate("aes"), "path": "aes::Aes256", "args": []}}
GCM = {"Adt": {"krate": crate("aes_gcm"), "path": "aes_gcm::AesGcm", "args": [AES]}}
FACTS = {
    "facts_version": 37,
    "krate": CRATE,
    "sites": [
        call("x25519::x25519", "x25519", 3, "main", "Reachable"),
        call("x25519::x25519", "x25519", 3, "main::generic"),
        call("aead::Aead::encrypt", "aead", 7, "seal", self_ty=GCM),
        {"tier": "Present", "owner": owner("table"), "span": loc(9), "target": {"Static": {"def": {"krate": crate("ring"), "path": "ring::digest::SHA256", "id": "s"}}}, "via": [], "expansion": None},
        call("other::nothing", "other", 11, "main"),
    ],
    "data_edges": [],
    "reach": {"artifact": "bin", "instances": 3, "truncated": False, "statics": [], "fns": ["main", "seal"], "boundary": [{"owner": owner("main"), "span": loc(3), "callee": {"krate": crate("x25519"), "path": "x25519::x25519", "id": "i"}}, {"owner": owner("main"), "span": loc(20), "callee": {"krate": crate("x25519"), "path": "x25519::x", "id": "i"}, "on_behalf": "Package"}, {"owner": owner("main"), "span": loc(21), "callee": {"krate": crate("x25519"), "path": "x25519::y", "id": "i"}}]},
    "links": {"named": [{"func": "f", "arity": 1, "sig": "s"}, {"func": "f", "arity": 1, "sig": "s"}]},
}
KB = """
[[crate]]
package = "x25519"
versions = ">=1, <2"
role = "algorithm"
[[crate]]
package = "aes-gcm"
versions = ">=0.10"
role = "algorithm"
[[crate]]
package = "aes"
role = "algorithm"
[[crate]]
package = "ring"
role = "algorithm"
[[fn]]
crate = "x25519"
path = "^x25519::x25519$"
asset = "x25519"
primitive = "key-agree"
functions = ["keyderive"]
[[fn]]
crate = "x25519"
path = "x25519"
asset = "later"
[[type]]
crate = "aes_gcm"
name = "AesGcm"
asset = "AES-GCM"
primitive = "ae"
functions = ["encrypt", "decrypt"]
[[type]]
crate = "aes"
name = "Aes256"
asset = "AES-256"
primitive = "block-cipher"
[[static]]
crate = "ring"
path = "SHA256$"
asset = "SHA-256"
primitive = "hash"
functions = ["digest"]
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("facts")
    (path / "app-1.json").write_text(json.dumps(FACTS, indent=1))
    (path / "old-2.json").write_text(json.dumps(FACTS | {"facts_version": 36}))
    return path


@pytest.fixture(scope="module")
def facts(spark, folder):
    return model.read_facts(spark, f"{folder}/*.json", spark.createDataFrame([("app-1",)], "unit string"))


def test_facts_are_read_exactly(spark, folder, facts):
    site = model.sites(facts).orderBy("ord").collect()
    assert [s["kind"] for s in site] == ["call", "call", "call", "static", "call"]
    assert site[0]["const_args"] == [None, "170141183460469231731687303715884105727"] and site[0]["offset"] == 4
    assert str(facts.select("sites.target.Call.arg_lens").first()[0][0][0]) == "18446744073709551615"
    assert model.links(facts, "named").count() == 1
    with pytest.raises(Exception, match="facts version 36, not 37"):
        model.sites(model.read_facts(spark, f"{folder}/*.json")).collect()


def test_assets_from_facts(spark, facts):
    kb = manifests.read_knowledge(spark, KB)
    assert manifests.knowledge_errors(kb).isEmpty()
    found = analysis.occurrences(facts, kb)
    got = sorted(tuple(r) for r in analysis.assets(found).select("asset_key", "usage", "n", "places", "uses").collect())
    assert got == [
        ("AES-256|block-cipher|", "reachable", 1, "src/main.rs:7:4", ""),
        ("AES-GCM|ae|", "reachable", 1, "src/main.rs:7:4", "decrypt,encrypt"),
        ("SHA-256|hash|", "present", 1, "src/main.rs:9:4", "digest"),
        ("x25519|key-agree|", "reachable", 1, "src/main.rs:3:4", "keyderive"),
    ]
    more = manifests.read_knowledge(spark, KB + '[[operation]]\ncrates = ["other", "x25519"]\npath = "nothing$|x25519$"\nprimitive = "kdf"\n')
    unknown = analysis.unknown_calls(facts, more, found).collect()
    assert [(r["asset"], r["line"], r["symbol"], r["reason"]) for r in unknown] == [("unknown kdf", 11, "other::nothing", "no algorithm named")]
    covered = analysis.coverage(model.boundary_edges(facts), found)
    assert sorted((r["line"], r["verdict"]) for r in covered.collect()) == [(3, "cited"), (20, "on behalf of another"), (21, "uncovered")]
    assert analysis.boundary_lines(covered).first()[0].split("\t")[:2] == ["src/main.rs:3:4", "cited"]
    doc = analysis.document(analysis.assets(found))
    assert analysis.document_errors(doc).isEmpty()
    assert doc.first() == analysis.document(analysis.assets(found)).first()
    assert not analysis.document_errors(spark.createDataFrame([('{"bomFormat":"x"}',)], "document string")).isEmpty()
    assert analysis.from_document(doc).count() == 4
    labels = manifests.read_labels(spark, '[[site]]\nfile="src/main.rs"\nline=9\ncallee="x"\nmust=["SHA-256"]\n[[site]]\nfile="src/main.rs"\nline=50\ncallee="x"\nmust=["SHA-256"]')
    assert [r["verdict"] for r in analysis.score_sites(labels, analysis.from_document(doc)).orderBy("line").collect()] == ["correct", "miss"]
    assert analysis.summary_lines(analysis.assets(found)).count() == 8


def test_knowledge_is_checked(spark):
    bad = manifests.read_knowledge(spark, '[[crate]]\npackage="a"\nrole="king"\n[[fn]]\ncrate="b"\npath="x"\nasset="A"\nfamily="F"')
    assert sorted(r["error"] for r in manifests.knowledge_errors(bad, ["G"]).collect()) == ["no such crate: b", "no such family: F", "no such role: king"]
    with pytest.raises(ValueError, match="unknown sections"):
        manifests.read_knowledge(spark, "[[nonsense]]\nx=1")


def metadata():
    def pkg(i, *, member=False, deps=(), features=None, macro=False):
        return {"id": i, "name": i, "version": "1.0.0", "manifest_path": f"/d/{i}/Cargo.toml", "source": None if member else "reg", "features": features or {}, "targets": [{"kind": ["proc-macro" if macro else "lib"], "name": i}], "dependencies": [{"name": n, "optional": o, "rename": None} for n, o in deps]}

    def node(i, *deps, features=()):
        return {"id": i, "features": list(features), "deps": [{"name": d, "pkg": d, "dep_kinds": [{"kind": k}]} for d, k in deps]}

    packages = [pkg("app", member=True, deps=[("lib", False), ("mac", False), ("opt", True), ("weak", True)], features={"on": ["dep:opt"], "w": ["weak?/x"]}), pkg("lib", deps=[("deep", False)]), pkg("mac", deps=[("deep", False), ("host", False)], macro=True), pkg("deep"), pkg("host"), pkg("opt"), pkg("weak"), pkg("tool"), pkg("test")]
    nodes = [node("app", ("lib", None), ("mac", None), ("opt", None), ("weak", None), ("tool", "build"), ("test", "dev"), features=["on", "w"]), node("lib", ("deep", None)), node("mac", ("deep", None), ("host", None)), *map(node, ("deep", "host", "opt", "weak", "tool", "test"))]
    return {"packages": packages, "workspace_members": ["app"], "workspace_root": "/d", "target_directory": "/d/target", "resolve": {"nodes": nodes}}


def test_package_scopes(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(metadata()))
    graph = manifests.read_package_graph(spark, str(tmp_path / "m.json"))
    pkgs = manifests.packages(graph).cache()
    deps = manifests.activated(manifests.dependencies(graph), pkgs)
    got = {r["id"]: r["scope"] for r in manifests.scopes(pkgs, deps).collect()}
    assert got == {"app": 0, "lib": 0, "mac": 0, "deep": 0, "opt": 0, "host": 1, "tool": 1}
    crates = spark.createDataFrame([("deep", ">=0.9, <2", "algorithm"), ("opt", "<1", "algorithm"), ("app", None, "trait")], "package string, versions string, role string")
    assert [r["name"] for r in manifests.supported(pkgs, crates).collect()] == ["deep"]


def test_text_sources(spark, tmp_path):
    toml = '[package]\nname = "a"\nlinks = "z"\n[dependencies]\nfoo = "1" # foo\n  "bar" = "2"\n[dependencies.baz]\nversion = "1"\n[target.\'cfg(unix)\'.dependencies]\nfoo.version = "3"\n'
    keys = manifests.manifest_keys(spark.createDataFrame([("Cargo.toml", toml)], "path string, text string")).cache()
    wanted = spark.createDataFrame([("Cargo.toml", "foo", "normal", None), ("Cargo.toml", "foo", "normal", "cfg(unix)"), ("Cargo.toml", "baz", "normal", None), ("Cargo.toml", "bar", "normal", None), ("Cargo.toml", "no", "normal", None)], "path string, key string, kind string, target string")
    found = {(r["key"], r["target"]): (r["line"], r["col"]) for r in manifests.dependency_key(keys, wanted).collect()}
    assert found == {("foo", None): (5, 0), ("foo", "cfg(unix)"): (10, 0), ("baz", None): (7, 14), ("bar", None): (6, 2)}
    assert [tuple(r) for r in manifests.links_key(keys).collect()] == [("Cargo.toml", 3, 0)]
    (tmp_path / "tree.txt").write_text("a v1.0.0 (/x)|std,alloc\nb v2.0.0|\na v1.0.0|extra\nnoise\n")
    assert [(r["name"], r["features"]) for r in manifests.read_features(spark, str(tmp_path / "tree.txt")).orderBy("name").collect()] == [("a", ["alloc", "extra", "std"]), ("b", [])]
    (tmp_path / "log.txt").write_text("finding: b\nx\nfinding: a\nfinding: b\n")
    assert [r[0] for r in manifests.findings(spark, str(tmp_path / "log.txt"), "finding: ").collect()] == ["a", "b"]
    projects = manifests.read_projects(spark, '[[project]]\nlabels="l"\npath="p"\nsha256="00"')
    assert manifests.wrong_archives(projects, spark.createDataFrame([("p", bytearray(b"x"))], "project string, content binary")).count() == 1
    sinks.write_lines(spark.createDataFrame([("b",), ("a",)], "line string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "a\nb\n"
    assert sinks.convert_report(spark.createDataFrame([("f", 3)], "File string, Ln long"), {"file": "File", "line": "Ln", "asset": "Alg"}).first() == ("f", 3, None)


def test_streams_agree_with_batches(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"2024-01-01 0{k % 4}:0{k % 10}:00", "abc"[k % 3]) for k in range(40)], "id long, at string, kind string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    frame.unionByName(frame).repartition(3).write.parquet(str(tmp_path / "in"))
    patterns = [("first", "a"), ("second", "[ab]")]

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    stream = events.read_stream(spark, str(tmp_path / "in"), 3)
    batch = [tuple(r) for r in events.matched_counts(frame.unionByName(frame), "kind", patterns).collect()]
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(run(events.matched_counts(stream, "kind", patterns, late="10 days"), "counts", "complete"), key=key) == sorted(batch, key=key)
    assert len(run(events.distinct_rows(stream, ["id"], late="10 days"), "distinct_ids", "append")) == 40
    made = events.sessions(frame, "kind")
    assert made.agg(F.sum("n")).first()[0] == 40
