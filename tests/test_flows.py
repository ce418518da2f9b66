"""Whole flows on small inputs: generated scenes, index, video query, selection, replay, command line."""

import io
import json
import shutil
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift import __main__ as cli
from framesift.functions import ordering
from framesift.operators import descriptor, evaluation, selection, synthetic
from framesift.plans import frame_selection, video_query
from framesift.sources import index_store, media, png, sinks, video


def write_y4m(path, frames, fps=10):
    h, w = frames[0].shape[:2]
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F{fps}:1 C444\n".encode())
        for rgb in frames:
            r, g, b = (rgb[:, :, c].astype(float) for c in range(3))
            y = 16 + 0.257 * r + 0.504 * g + 0.098 * b
            u, v = 128 - 0.148 * r - 0.291 * g + 0.439 * b, 128 + 0.439 * r - 0.368 * g - 0.071 * b
            f.write(b"FRAME\n" + b"".join(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in (y, u, v)))


def scene(k, size=(64, 48)):
    layouts = synthetic.family_layouts(synthetic.scene_seed(7, f"dev-{k:03d}"))
    return synthetic.render_scene(layouts["base"], synthetic.SUBJECTS[k % 3], ("warm", "cool")[k % 2], size)


@pytest.fixture(scope="module")
def collection(tmp_path_factory):
    root = tmp_path_factory.mktemp("collection")
    for k in range(14):
        (root / f"s{k % 2}").mkdir(exist_ok=True)
        (root / f"s{k % 2}" / f"{k:02d}.png").write_bytes(png.encode(scene(k)))
    (root / "bad.jpg").write_bytes(b"x" * 99)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "a.png").write_bytes(png.encode(scene(1)))
    (root / "link.png").symlink_to(root / "s0" / "00.png")
    (root / "notes.txt").write_text("no image")
    return root


@pytest.fixture(scope="module")
def film(tmp_path_factory):
    path = tmp_path_factory.mktemp("film") / "film.y4m"
    write_y4m(path, [scene(k // 20) for k in range(60)])
    return str(path)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(3)
    for shape in ((5, 7), (6, 4, 3)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(png.decode(png.encode(x)).reshape(shape), x)
    import struct
    import zlib

    x = rng.integers(0, 256, (5, 12)).astype(int)  # 4 RGB pixels a line, each line by another filter
    lines, above = b"", np.zeros(12, int)
    for kind, line in enumerate(x):
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        nearest = np.select([(abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), abs(p - above) <= abs(p - corner)], [left, above], corner)
        guess = (0, left, above, (left + above) // 2, nearest)[kind]
        lines += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(png.decode(data).reshape(5, 12), x)
    for broken in (data[:-20], data[:40] + b"zz" + data[42:], b"no"):
        with pytest.raises(ValueError):
            png.decode(broken)


def test_row_numbers(spark):
    rows = [f"k{(i * 7919) % 1000:04d}" for i in range(1000)]
    got = ordering.row_numbers(spark.createDataFrame([(r,) for r in rows], "k string").repartition(7), "k", "n", rows=90)
    assert [(r["n"], r["k"]) for r in got.orderBy("n").collect()] == list(enumerate(sorted(rows)))
    assert ordering.row_numbers(spark.range(0), "id", "n").count() == 0


def test_collection(spark, collection):
    files = media.inventory(spark, str(collection))
    assert files.count() == 15  # no hidden name, link, or other kind of file
    d = media.decode(media.scan(spark, str(collection)), media.plain_decoder).cache()
    assert media.summary(d).first().asDict() == {"candidates": 15, "usable": 14, "invalid": 1, "bytes": sum(p.stat().st_size for p in collection.glob("s*/*.png"))}
    assert [tuple(r) for r in media.extension_histogram(media.usable(d)).collect()] == [(".png", 14)]
    with pytest.raises(ValueError):
        media.usable(media.errors(d).filter("false").withColumn("error", F.lit("x")), required=True)
    small = media.decode(media.scan(spark, str(collection)), media.plain_decoder, max_side=16, colour=True).filter("error is null").first()
    assert (small["source_width"], small["source_height"], small["width"], small["height"], len(small["pixels"])) == (64, 48, 16, 12, 16 * 12 * 3)
    with pytest.raises(ValueError):
        media.inventory(spark, str(collection / "missing"))

    def huge(data):
        raise SyntaxError("too large")

    assert media.errors(media.decode(media.scan(spark, str(collection)), huge)).count() == 15


def test_semantic_encoder(spark, collection):
    d = media.decode(media.scan(spark, str(collection)), media.plain_decoder, colour=True)
    seen = (F.col("pixels"), F.col("width"), F.col("height"))

    def make(scale):
        def encode(pictures):
            assert len(pictures) <= 4
            return np.array([[scale, 0, 0] for _ in pictures])

        return lambda: encode

    got = d.withColumn("v", descriptor.semantic_column(*seen, make(1.0), 3, batch=4)).select("error", "v").collect()
    assert sum(r["v"] == [1.0, 0.0, 0.0] for r in got) == 14 and sum(r["v"] is None and r["error"] is not None for r in got) == 1
    with pytest.raises(Exception, match="invalid or zero"):
        d.withColumn("v", descriptor.semantic_column(*seen, make(0.0), 3, batch=4)).collect()


def test_thumbnails(spark, collection):
    got = media.thumbnails(media.scan(spark, str(collection)), 16, media.plain_decoder).collect()
    assert sum(r["error"] is not None for r in got) == 1
    assert all(png.decode(bytes(r["content"])).shape == (12, 16, 3) for r in got if r["error"] is None)


def test_decoders():
    assert media.plain_decoder(b"P5 2 1 255 \x01\x02").tolist() == [[[1], [2]]]
    assert media.plain_decoder(b"P6 1 1 255 abc").shape == (1, 1, 3)
    for bad in (b"P5 2 2 255 \x01", b"GIF89a", b""):
        with pytest.raises(ValueError):
            media.plain_decoder(bad)


def test_inspect_and_index(spark, collection, tmp_path):
    summary = cli.inspect(spark, str(collection), str(tmp_path / "inspect"))
    assert summary["invalid_images"] == 1 and summary["extensions"] == {".png": 14}
    index = str(tmp_path / "index")
    manifest = cli.build_index(spark, str(collection), index, batch_rows=4)
    assert manifest["counts"] == {"usable": 14, "invalid": 1} and manifest["processed"] == 15
    assert len(list(Path(index, "checkpoint").glob("batch=*"))) == 4
    assert cli.build_index(spark, str(collection), index)["reused"] == 15
    with pytest.raises(ValueError, match="rebuild"):  # another descriptor must not be mixed in
        cli.build_index(spark, str(collection), index, max_side=32)
    assert cli.build_index(spark, str(collection), index, max_side=32, rebuild=True)["processed"] == 15
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(ValueError):
        cli.build_index(spark, str(collection), str(tmp_path / "other"))
    files = media.inventory(spark, str(collection))
    store = index_store.VectorIndex(spark, str(tmp_path / "changing"), 576, descriptor.SpatialDescriptor().metadata())
    encode = cli.encoder_of(media.scan(spark, str(collection)), descriptor.SpatialDescriptor())
    with pytest.raises(RuntimeError, match="changed"):
        store.build(files, encode, again=lambda: files.limit(3))


def test_scan_of_a_video(spark, film, tmp_path):
    scanned = video.scan(spark, {"film": film}).cache()
    assert scanned.count() == 60 and scanned.first()["fps"] == 10
    scores = [r["change"] for r in scanned.orderBy("frame_number").collect()]
    assert {i for i, s in enumerate(scores) if s > 5} == {20, 40}
    numbered, shots = video.shots(scanned, 10.0, threshold=5.0, min_frames=5)
    assert [(r["start_frame"], r["end_frame"]) for r in shots.orderBy("shot_id").collect()] == [(0, 20), (20, 40), (40, 60)]
    wanted = spark.createDataFrame([("film", 30), ("film", 3)], "video_id string, frame_number long")
    got = {r["frame_number"]: r for r in video.read_selected(wanted, {"film": film}).collect()}
    assert set(got) == {3, 30} and abs(np.frombuffer(got[30]["pixels"], np.uint8).astype(int) - scene(1).ravel()).max() <= 4
    for bad in ([("film", 99)], [("film", 3), ("film", 3)], [("none", 1)]):
        with pytest.raises(Exception):  # noqa: B017
            video.read_selected(spark.createDataFrame(bad, "video_id string, frame_number long"), {"film": film}).collect()
    cut = tmp_path / "cut.y4m"
    cut.write_bytes(Path(film).read_bytes()[:-10])
    with pytest.raises(Exception, match="truncated"):
        video.scan(spark, {"cut": str(cut)}).collect()
    for bad in ({"threshold": 0.0}, {"threshold": float("nan")}, {"min_frames": 0}):
        with pytest.raises(ValueError):
            video.shots(scanned, 10.0, **bad)


def test_hue_saturation_value():
    import colorsys

    x = np.random.default_rng(2).integers(0, 256, (4, 5, 3), dtype=np.uint8)
    got = video.hue_saturation_value(x)
    for p, q in zip(x.reshape(-1, 3), got.reshape(-1, 3), strict=True):
        h, s, v = colorsys.rgb_to_hsv(*(p / 255))
        assert q == pytest.approx([h * 180, s * 255, v * 255], abs=1e-6)


def test_query_select_and_replay(spark, collection, film, tmp_path):
    index, out = str(tmp_path / "index"), str(tmp_path / "query")
    cli.build_index(spark, str(collection), index)
    found = video_query.run(spark, film, index, out, top_k=3, interval=0.5, threshold=5.0, min_frames=5)
    assert found == {"shot_count": 3, "query_count": 9}
    results = json.loads(Path(out, "results.json").read_text())
    best = results["shots"][0]["queries"][0]["matches"][0]
    assert best["rank"] == 1 and best["relative_path"] == "s0/00.png" and best["score"] > 0.95
    sinks.verify_complete(out)
    assert results["thumbnail_errors"] == [] and len(list(Path(out, "candidates").glob("*.png"))) >= 3 and "created_at" in results
    with pytest.raises(ValueError, match="not empty"):
        video_query.run(spark, film, index, out)

    book = tmp_path / "book.xlsx"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/media/a.png", png.encode(scene(0)))
        z.writestr("xl/media/b.png", png.encode(scene(2)))
        z.writestr("xl/media/c.png", png.encode(np.zeros((20, 20), np.uint8)))
    profile = {"workbook": "book.xlsx", "examples": [
        {"name": "first", "criterion": "c", "preferred": "xl/media/a.png", "less_preferred": "xl/media/b.png"},
        {"name": "never", "criterion": "c", "preferred": "xl/media/c.png"},
    ]}
    (tmp_path / "profile.json").write_text(json.dumps(profile))
    review = {"results_sha256": sinks.sha256_file(f"{out}/results.json"), "selected": [{"frame_number": 10, "view": "v", "reason": "r"}]}
    (tmp_path / "review.json").write_text(json.dumps(review))
    target = str(tmp_path / "selection")
    done = cli.select(spark, f"{out}/results.json", target, top_k=4, min_relevance=0.3, duplicate=0.999, profile=str(tmp_path / "profile.json"), review=str(tmp_path / "review.json"))
    assert done["candidates"] == 9 and 1 <= done["selected"] <= 4
    report = json.loads(Path(target, "selection.json").read_text())
    assert report["trace"][0]["feedback_example"] == "first" and Path(target, "candidate-scores.csv").read_text().count("\n") == 10
    assert len(list(Path(target, "selected").glob("01-frame-*.png"))) == 1 and Path(target, "selected-frames.zip").exists()
    assert report["feedback_source"]["workbook_sha256"] == sinks.sha256_file(str(book))
    assert "never" in (tmp_path / "selection-report.html").read_text()
    review["results_sha256"] = "0"
    (tmp_path / "review.json").write_text(json.dumps(review))
    with pytest.raises(ValueError, match="other results"):
        cli.select(spark, f"{out}/results.json", str(tmp_path / "s2"), min_relevance=0.3, review=str(tmp_path / "review.json"))

    assert frame_selection.replay_folder(target, str(tmp_path / "again"))["identical"]
    sinks.verify_complete(str(tmp_path / "again"))
    for name, change in (("frame-similarities.npy", b"x"), ("selection.json", b" ")):
        copy = tmp_path / f"copy-{name}"
        shutil.copytree(target, copy)
        (copy / name).write_bytes((copy / name).read_bytes() + change)
        with pytest.raises(ValueError):
            frame_selection.replay_folder(str(copy), str(tmp_path / f"out-{name}"))
    with pytest.raises(ValueError, match="contain"):
        frame_selection.replay_folder(target, target + "/below")


def test_synthetic_set_and_its_evaluation(spark, tmp_path):
    root = str(tmp_path / "set")
    made = cli.make_synthetic(spark, root, families=1, size=(64, 48))
    assert (made["image_count"], made["layout_count"], made["pair_count"]) == (96, 8, 144)
    before = sinks.file_digests(root)
    assert cli.make_synthetic(spark, root, families=1, size=(64, 48)) == made and sinks.file_digests(root) == before
    with pytest.raises(ValueError):
        cli.make_synthetic(spark, root, seed=1, families=1, size=(64, 48))
    found = cli.evaluate(spark, root, str(tmp_path / "out"), "all")
    assert set(found["splits"]) == {"dev", "test"}
    dev = found["splits"]["dev"]
    assert dev["images"] == 48 and dev["layouts"] == 4 and dev["random_expected"] == pytest.approx(11 / 47)
    assert dev["precision_at_10"] > 2 * dev["random_expected"] and np.load(tmp_path / "out" / "features-dev.npy").shape == (48, 576)
    with pytest.raises(ValueError):
        evaluation.split_of(spark.range(1), "other")
    picture = next(Path(root, "images", "dev").glob("*.png"))
    picture.write_bytes(png.encode(scene(3)))
    with pytest.raises(ValueError, match="differ"):
        cli.evaluate(spark, root, str(tmp_path / "out2"))
    Path(root, "pairs.jsonl").write_text("")
    with pytest.raises(ValueError, match="label files"):
        cli.evaluate(spark, root, str(tmp_path / "out3"))


def test_rendered_scenes():
    layouts = synthetic.family_layouts(synthetic.scene_seed(synthetic.SEED, "dev-000"))
    assert layouts["position"]["center_x"] == 1 - layouts["base"]["center_x"] and layouts["background"]["horizon"] == layouts["base"]["horizon"] + 0.35
    assert layouts == synthetic.family_layouts(synthetic.scene_seed(synthetic.SEED, "dev-000"))
    for subject in synthetic.SUBJECTS:
        x = synthetic.render_scene(layouts["base"], subject, "warm")
        own = np.argwhere((x == synthetic.PALETTES["warm"][2]).all(axis=2))
        w, h = synthetic.SIZE
        box = layouts["base"]
        for axis, centre, extent, n in ((1, "center_x", "width", w), (0, "center_y", "height", h)):  # the subject fills its box
            lo, hi = (box[centre] - box[extent] / 2) * (n - 1), (box[centre] + box[extent] / 2) * (n - 1)
            assert abs(own[:, axis].min() - lo) <= 2 and abs(own[:, axis].max() - hi) <= 2
    a, b = (synthetic.render_scene(layouts["base"], "car", "textured", seed=s) for s in (5, 5))
    assert np.array_equal(a, b) and len(np.unique(a.reshape(-1, 3), axis=0)) > 10
    with pytest.raises(ValueError):
        synthetic.render_scene(layouts["base"], "boat", "warm")


def test_descriptor_against_plain_loops():
    rng = np.random.default_rng(4)
    for h, w in ((9, 13), (3, 20), (16, 16)):
        x = rng.integers(0, 256, (h, w)).astype(float)
        z = (x - x.mean()) / x.std()
        light, count, edges = np.zeros(64), np.zeros(64), np.zeros((64, 8))
        dy, dx = np.gradient(z)
        for i in range(h):
            for j in range(w):
                c = (i * 8 // h) * 8 + j * 8 // w
                light[c] += z[i, j]
                count[c] += 1
                a = (np.arctan2(dy[i, j], dx[i, j]) % np.pi) * 8 / np.pi
                k = int(a)
                edges[c, k % 8] += np.hypot(dx[i, j], dy[i, j]) * (1 - (a - k))
                edges[c, (k + 1) % 8] += np.hypot(dx[i, j], dy[i, j]) * (a - k)
        light /= np.maximum(count, 1)
        want = np.append(light / np.linalg.norm(light), edges.ravel() / np.linalg.norm(edges)) / np.sqrt(2)
        assert np.allclose(descriptor.SpatialDescriptor(blur_radius=0.0).encode(x), want, atol=1e-6)


def test_descriptor_parameters_and_help():
    for bad in ({"grid_size": 0}, {"grid_size": 2.5}, {"max_side": 0}, {"blur_radius": -1}, {"blur_radius": float("nan")}, {"intensity_weight": 1.5}):
        with pytest.raises(ValueError):
            descriptor.SpatialDescriptor(**bad)
    assert descriptor.SpatialDescriptor(orientation_bins=1, grid_size=2).encode(np.arange(36).reshape(6, 6)).shape == (8,)
    x = np.arange(100.0).reshape(10, 10)
    assert descriptor.shrunk(x, 5) == pytest.approx(x.reshape(5, 2, 5, 2).mean(axis=(1, 3))) and descriptor.shrunk(x, 20) is x
    assert descriptor.blurred(np.full((6, 6), 7.0), 2.0) == pytest.approx(np.full((6, 6), 7.0))
    good = np.eye(3, dtype=np.float32)
    assert descriptor.check_semantic(good, 3, 3) is not None
    for bad in (good * 0, good * 2, good[:2], good * np.nan):
        with pytest.raises(ValueError):
            descriptor.check_semantic(bad, 3, 3)


def brute_decisions(frames, scores, eligible, sim, count, penalty, duplicate):
    chosen, left = [], [i for i in range(len(frames)) if eligible[i]]
    while left and len(chosen) < count:
        live = [(round(round(scores[i], 6) - round(penalty * max((sim[i][j] for j in chosen), default=0.0), 6), 6), -frames[i], i) for i in left if not chosen or max(sim[i][j] for j in chosen) < duplicate]
        if not live:
            break
        chosen.append(max(live)[2])
        left.remove(chosen[-1])
    return chosen


def test_decisions_against_plain_loops():
    rng = np.random.default_rng(9)
    for n in (1, 5, 40):
        frames = rng.permutation(200)[:n].tolist()
        scores, eligible = rng.random(n).round(2).tolist(), (rng.random(n) < 0.8).tolist()
        sim = selection.similarity_matrix(rng.normal(size=(n, 3)) / 1.5)
        chosen, trace, ds = selection.rank_candidates(frames, scores, eligible, sim, 10, penalty=0.4, duplicate=0.9)
        assert chosen == brute_decisions(frames, scores, eligible, sim, 10, 0.4, 0.9)
        assert all([p["frame_number"] for p in t["pool"]] == sorted(p["frame_number"] for p in t["pool"]) for t in trace)
        assert len(ds) == n and all(p["max_similarity"] == 0 and p["nearest_previously_selected"] is None for p in (trace[0]["pool"] if trace else []))
    with pytest.raises(ValueError):
        selection.rank_candidates([1], [float("nan")], [True], np.eye(1), 1)
    for bad in ({}, {"a": -1.0}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            selection.check_weights(bad)


def test_exports(tmp_path):
    (tmp_path / "a.png").write_bytes(b"one")
    items = [(7, str(tmp_path / "a.png"), sinks.sha256_file(str(tmp_path / "a.png")))]
    out = str(tmp_path / "out")
    assert sinks.export_selected(items, out) == ["selected/01-frame-00000007.png"]
    with zipfile.ZipFile(io.BytesIO(Path(out, "selected-frames.zip").read_bytes())) as z:
        assert z.read("01-frame-00000007.png") == b"one"
    with pytest.raises(ValueError):
        sinks.export_selected([(7, items[0][1], "0")], str(tmp_path / "out2"))
    sinks.write_npy(np.arange(3), f"{out}/x.npy")
    assert sinks.read_npy(f"{out}/x.npy").tolist() == [0, 1, 2] and not Path(f"{out}/x.npy.staged").exists()
    assert sinks.image_link("a b/ü.png") == "a%20b/%C3%BC.png"


def test_profiles():
    fine = {"examples": [{"name": "n", "criterion": "c", "preferred": "xl/media/a.png"}]}
    assert media.feedback_profile(fine, {"xl/media/a.png"})[0]["preferred"] == "xl/media/a.png"
    for member in ("xl/media/../a.png", "docProps/a.png", "xl/media/none.png"):
        with pytest.raises(ValueError):
            media.feedback_profile({"examples": [{"name": "n", "criterion": "c", "preferred": member}]}, {"xl/media/a.png"})
    with pytest.raises(ValueError):
        media.feedback_profile({"examples": [{"name": "n", "criterion": "c", "less_preferred": "xl/media/a.png"}]}, {"xl/media/a.png"})


def test_command_line(collection, tmp_path, capsys):
    for bad in (["query", "--video", "x", "--top-k", "0"], ["query", "--video", "x", "--interval-seconds", "nan"], ["evaluate-synthetic", "--split", "x"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    a = cli.parser().parse_args(["index", "--images", "i", "--index", "x", "--rebuild", "--descriptor-max-side", "64"])
    assert a.rebuild and a.descriptor_max_side == 64
    assert cli.main(["replay-selection", "--selection", str(tmp_path / "none"), "--output", str(tmp_path / "o")]) == 1
    assert "error:" in capsys.readouterr().err
