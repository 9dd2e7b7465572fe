import json

import pytest

from docloom.sources.jsobject import read_objects, to_json

GOOD = '// a base\nwindow.KB = {meta: {version: 2, ok: true, none: null,}, cards: [{id: "a\\u00e9", "t": -1.5e2,}, ], /* end */};\n'


def test_literal():
    assert json.loads(to_json(GOOD)) == {"meta": {"version": 2, "ok": True, "none": None}, "cards": [{"id": "aé", "t": -150.0}]}


@pytest.mark.parametrize("text", ["var x = {}", "window.KB = {a: 'b'}", "window.KB = {a: `b`}", "window.KB = {a: b}", "window.KB = {a: 1", "window.KB = {a: 1} + 2", "", "window.KB = [,]", "window.KB = {a: [1,,]}", "window.KB = {,}", "window.KB = {a: 1, b /* no colon */}"])
def test_refused(text):
    with pytest.raises(ValueError, match="line 1, column"):
        to_json(text)


def test_files(spark, tmp_path):
    (tmp_path / "good.js").write_text(GOOD)
    (tmp_path / "bad.js").write_text("window.KB = {\n  a: 'x'}")
    got = {r.path.rsplit("/", 1)[1]: r for r in read_objects(spark, str(tmp_path)).collect()}
    assert got["good.js"].error is None and json.loads(got["good.js"].json)["meta"]["version"] == 2
    assert got["bad.js"].json is None and got["bad.js"].error.startswith("line 2, column 6")


def test_comments_between_key_and_colon():
    assert json.loads(to_json("window.KB = {a /* x */ : 1, b // y: z\n : [2, /* last */ ], }")) == {"a": 1, "b": [2]}


def test_large_files_take_linear_time():
    import time

    text = "window.KB = {" + ", ".join(f"key{i}: {i}" for i in range(60_000)) + "}"
    start = time.perf_counter()
    assert len(json.loads(to_json(text))) == 60_000
    assert time.perf_counter() - start < 5
