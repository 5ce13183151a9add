import json

import pytest

from quireflow.sources import layouts, services


def test_layouts(spark, tmp_path):
    rows = [
        {"page": 1, "width": 10.0, "height": 20.0, "parsing_res_list": [{"block_content": "a", "block_bbox": [1, 2, 3, 4], "block_label": "text"}]},
        {"page": 2, "shape": [20, 10], "parsing_res_list": [{"text": "b", "box": [[1, 2], [3.5, 4]]}, {"rec_text": "c"}]},
        {"page": 3, "img_size": [7, 8]},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r.page: r for r in layouts.read_layouts(spark, str(tmp_path)).collect()}
    assert (got[1].width, got[2].width, got[2].height, got[3].height) == (10, 10, 20, 8)
    assert got[1].parsing_res_list[0].block_bbox == [1, 2, 3, 4] and got[2].parsing_res_list[0].block_bbox == [1, 2, 3.5, 4]
    assert [b.block_content for b in got[2].parsing_res_list] == ["b", "c"] and got[3].parsing_res_list is None


def test_discovery(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt", "d_searchable.pdf", "ocr_output/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in layouts.discover(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]


def test_retries():
    waits = []
    answers = iter([(503, []), (429, []), (200, ["a", "b"])])
    assert services.call(lambda p: next(answers), [1, 2], "line", sleep=waits.append) == ["a", "b"] and waits == [2.0, 4.0]
    for kind, status in (("line", 500), ("document", 400)):
        with pytest.raises(RuntimeError):
            services.call(lambda p, s=status: (s, []), [1], kind, sleep=waits.append)
    with pytest.raises(ValueError):
        services.call(lambda p: (200, []), [1], "line")


def test_recognise(spark):
    df = spark.createDataFrame([(k % 7, f"img{k % 7}") for k in range(20)], "id long, image string")
    got = services.recognise(df, "image", "id", lambda p: (200, [x.upper() for x in p]), size=3).collect()
    assert {r.id: r.answer for r in got} == {k: f"IMG{k}" for k in range(7)}


def test_answers_in_order():
    import threading
    import time

    import pytest

    from quireflow.sources import services as V

    lock, under, most, asked = threading.Lock(), 0, 0, []

    def ask(payload):
        nonlocal under, most
        with lock:
            under, asked_before = under + 1, asked.count(payload)
            most = max(most, under)
            asked.append(payload)
        time.sleep(0.02 if payload[:1] == b"a" else 0.001)
        with lock:
            under -= 1
        if payload == b"b1" and not asked_before:
            raise ConnectionError("once")
        return payload.decode()

    items = [b"a0", b"a1", b"b0", b"a2", b"b2"]
    assert list(V.in_order(items, ask)) == [x.decode() for x in items] and most == 2
    most = 0
    assert list(V.in_order(items, ask, budget=9)) == [x.decode() for x in items] and most == 1
    asked.clear()
    # One failure: asked for once more, and one at a time from then on.
    assert list(V.in_order([b"b1", *items], ask)) == ["b1", *[x.decode() for x in items]] and asked.count(b"b1") == 2

    def refuse(payload):
        raise V.Permanent("401")

    with pytest.raises(V.Permanent):
        list(V.in_order(items, refuse))
    assert list(V.in_order([], ask)) == []
