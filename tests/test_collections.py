import json
import random

import numpy as np
import pytest

from waymark.sources import collections as C
from waymark.sources import features as S

NASTY = ['a "quoted" }{ text', "back\\slash", "\\", '\\"', '"features": [{', "}]}", "ünï😀}", "\n\t", "", '{"type": "Feature"}']


def feature(rng, i):
    kind = rng.choice(["Point", "LineString", None])
    xy = lambda: [round(rng.random(), 3), round(rng.random(), 3)]
    shape = None if kind is None else {"type": kind, "coordinates": xy() if kind == "Point" else [xy() for _ in range(rng.randint(2, 30))]}
    own = {"type": "Feature", "properties": {rng.choice(["k", 'q"}']): rng.choice(NASTY), "n": {"deep": [{"x": [1, {"y": rng.choice(NASTY)}]}]}}, "geometry": shape}
    return own | ({"id": f"f{i}"} if i % 3 else {})


def collection(rng, n, first=0):
    before = {"name": rng.choice(NASTY), "crs": {"type": "name", "properties": {"features": [{"a": 1}], "name": "}"}}, "links": [{"type": "Feature"}, {"b": {}}]}
    after = {"bbox": [0, 0, 1, 1], "extra": [{"c": "{"}]}
    parts = {**(before if rng.random() < 0.7 else {}), "type": "FeatureCollection", "features": [feature(rng, first + i) for i in range(n)], **(after if rng.random() < 0.7 else {})}
    if rng.random() < 0.3:
        parts["type"] = parts.pop("type")  # the kind comes last
    return parts


def wanted(docs):
    out, seq = [], 0
    for doc in docs:
        for f in doc["features"]:
            out.append((seq, f.get("id", str(seq)), f["geometry"] and f["geometry"]["type"], len((f["geometry"] or {"coordinates": []})["coordinates"]), f["properties"]))
            seq += 1
    return out


def got(table):
    rows = table.select("seq", "id", "geom_type", "geometry_json", "properties_json").orderBy("seq").collect()
    return [(r.seq, r.id, r.geom_type, len(json.loads(r.geometry_json)["coordinates"]) if r.geometry_json else 0, json.loads(r.properties_json)) for r in rows]


@pytest.mark.parametrize(("size", "indent"), [("1500b", None), ("700b", 1)])
def test_collections_are_read_in_ranges(spark, tmp_path, size, indent):
    rng = random.Random(size)
    docs = [collection(rng, n, 1000 * n) for n in (20, 0, 3, 40)]
    for i, doc in enumerate(docs):
        (tmp_path / f"part {i}.geojson").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(i % 2)) + "\n" * (i % 2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        paths = [f"{tmp_path}/*.geojson"]
        many = C.starts(spark, paths).count()
        assert many > 12
        assert got(S.read_features(spark, paths)) == wanted(docs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_documents(spark, tmp_path):
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}
    esri = {"features": [{"attributes": {"FID": 3}, "geometry": {"x": 1, "y": 2}}, {"attributes": {}, "geometry": None}, {"attributes": {}, "geometry": {"paths": [[[0, 0], [1, 1]]]}}]}
    docs = [line, esri, {"type": "Feature", "id": 7, "geometry": line, "properties": {"features": [1]}}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": line}]}]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    rows = S.read_features(spark, f"{tmp_path}/*.json").orderBy("seq").collect()
    assert [(r.seq, r.id, r.geom_type) for r in rows] == [(0, "0", "LineString"), (1, "3", "Point"), (3, "3", "LineString"), (4, "7", "LineString"), (5, "5", "LineString")]


def test_lines(spark, tmp_path):
    rng = random.Random(4)
    docs = [{"features": [feature(rng, i) for i in range(n)]} for n in (5, 9)]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.ndjson").write_text("\n".join(json.dumps(f) for f in doc["features"]) + "\n\n")
    assert got(S.read_features(spark, f"{tmp_path}/*.ndjson")) == wanted(docs)


def test_failed_import_leaves_nothing(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"a": 1}')
    with pytest.raises(Exception, match="neither"):
        S.import_features(spark, str(bad), "default.imported_one")
    assert not spark.catalog.tableExists("default.imported_one")
    good = tmp_path / "good.json"
    good.write_text(json.dumps(collection(random.Random(1), 5)))
    try:
        assert S.import_features(spark, str(good), "default.imported_one", keep_source=True).count() == 5
        with pytest.raises(ValueError, match="exists"):
            S.import_features(spark, str(good), "default.imported_one")
    finally:
        spark.sql("DROP TABLE IF EXISTS default.imported_one")


def test_structure_against_a_plain_scan():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice('"\\{}[]ab') for _ in range(60)).lstrip("\\")
        for inside in (False, True):
            now, escaped, want = inside, False, []
            for c in text:
                hit = c == '"' and not escaped
                want.append((0 if now or hit else {"{": 1, "[": 1, "}": -1, "]": -1}.get(c, 0)))
                now ^= hit
                escaped = c == "\\" and not escaped
            _, step, ends = C.structure(np.frombuffer(text.encode(), np.uint8), inside)
            assert step.tolist() == want and ends == now
