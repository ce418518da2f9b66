"""Hand-computed answers for single operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import descriptor, evaluation, knn, scoring, selection, synthetic, timeline
from framesift.sources import index_store, media, sinks

MATRIX = np.array([[1, 0.98, 0.85, 0.3], [0.98, 1, 0.8, 0.3], [0.85, 0.8, 1, 0.2], [0.3, 0.3, 0.2, 1]])


def test_decision_trace():
    chosen, trace, ds = selection.rank_candidates([0, 1, 2, 3], [0.9, 0.85, 0.8, 0.76], [True] * 4, MATRIX, 2, [("Example", [0])])
    assert chosen == [0, 3]
    assert trace[1]["runner_up"] == 2 and trace[1]["utility_margin"] == pytest.approx(0.235)
    assert next(p for p in trace[1]["pool"] if p["frame_number"] == 1)["status"] == "duplicate_blocked"
    assert [d["status"] for d in ds] == ["selected", "redundant_in_final_set", "outside_top_k_budget", "selected"]


def test_ties_go_to_the_lower_frame():
    chosen, trace, _ = selection.rank_candidates([30, 10, 20], [0.8] * 3, [True] * 3, np.eye(3), 2)
    assert [t["winner"] for t in trace] == [10, 20] and trace[0]["utility_margin"] == 0


def test_negative_similarity_is_a_bonus_and_empty_seeds_leave_no_step():
    m = np.array([[1, -0.4], [-0.4, 1]])
    _, trace, _ = selection.rank_candidates([1, 2], [0.9, 0.5], [True, True], m, 2, [("none", [])])
    assert len(trace) == 2 and trace[1]["winner_utility"] == pytest.approx(0.7)


def test_empty_selection_and_argument_errors():
    assert selection.rank_candidates([1, 2], [1, 1], [False, False], np.eye(2), 17)[0] == []
    for bad in ({"penalty": -1}, {"penalty": float("nan")}, {"duplicate": 2}):
        with pytest.raises(ValueError):
            selection.rank_candidates([1], [1], [True], np.eye(1), 1, **bad)
    with pytest.raises(ValueError):
        selection.rank_candidates([1, 1], [1, 1], [True, True], np.eye(2), 1)


def test_replay():
    doc = selection.freeze([0, 1, 2, 3], [0.9, 0.85, 0.8, 0.76], [True] * 4, MATRIX, 2)
    assert selection.replay(doc)
    changed = json.loads(doc)
    changed["selected"] = [1, 3]
    assert not selection.replay(json.dumps(changed))


def test_plain_greedy():
    v = [[1, 0], [1, 0], [0, 1]]
    assert selection.choose_diverse([0.9, 0.8, 0.7], v, [True] * 3, 3) == [0, 2]
    assert selection.choose_diverse([1, 1, 1], v, [False] * 3, 17) == []
    assert selection.choose_diverse([1, 1, 1], v, [False, True, True], 1, seeds=(0, 2)) == [2]


def test_distinct_references(spark):
    rows = [(1, 0, 0.99, [1.0, 0.0]), (1, 1, 0.99, [1.0, 0.0]), (1, 2, 0.8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id long, image_id long, score double, embedding array<float>")
    assert [(r["image_id"], r["score"]) for r in scoring.distinct_references(df).orderBy("rank").collect()] == [(0, 0.99), (2, 0.8)]


def test_feedback_assignment(spark):
    s = [[0.99, 0.81], [0.8, 0.98], [0.83, 0.84]]
    df = spark.createDataFrame([(i, j, s[i][j]) for i in range(3) for j in range(2)], "row int, anchor int, similarity double")
    assert [r["anchor"] for r in scoring.assign_feedback(df).orderBy("row").collect()] == [0, 1, -1]


def test_preference_metrics(spark):
    r = evaluation.preference_metrics(spark.createDataFrame([(x,) for x in (0.1, -0.1, 0.0, 1e-8)], "margin double")).first()
    assert (r["wins"], r["losses"], r["ties"], r["accuracy"], r["tie_rate"]) == (1, 1, 2, 0.25, 0.5)


def test_ranking_leaves_out_the_query(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(12)], "id long, embedding array<float>")
    got = knn.top_k(df.filter("id = 3"), df, 10, exclude_self=True).orderBy("rank").collect()
    assert [r["image_id"] for r in got] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    for k in (0, 2049):
        with pytest.raises(ValueError):
            knn.top_k(df, df, k)
    with pytest.raises(ValueError, match="empty"):
        knn.top_k(df, df.limit(0), 3)
    with pytest.raises(ValueError):
        knn.top_k(spark.createDataFrame([(0, [1.0, 1.0])], "id long, embedding array<float>"), df, 3)
    for v in ([1.0, 1.0, 1.0], [float("nan"), 0.0, 0.0], [1.0, 0.0]):
        with pytest.raises(ValueError):
            knn.check_vectors(spark.createDataFrame([(0, v)], "id long, embedding array<float>"), 3)


def test_order_is_by_the_exact_score(spark):
    """Scores that differ after the sixth decimal rank by what they are; equal ones by id."""
    v = [(i, [float(np.sqrt(1 - s * s)), s]) for i, s in ((0, 0.5), (1, 0.5 + 1e-8), (2, 0.5), (3, 0.5 - 1e-8))]
    df = spark.createDataFrame(v, "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "id long, embedding array<double>")
    assert [r["image_id"] for r in knn.top_k(q, df, 4).orderBy("rank").collect()] == [1, 0, 2, 3]


def test_search_in_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 17)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 13)
    test_both_forms_of_search_agree(spark)


def test_both_forms_of_search_agree(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    rows = lambda d: sorted((r["query_id"], r["rank"], r["image_id"], round(r["score"], 6)) for r in d.collect())
    assert rows(knn.top_k(df, df, 5)) == rows(knn.top_k_sql(df, df, 5))


def _frames(spark, n=40, fps=10.0):
    return spark.createDataFrame([("v", i, i / fps) for i in range(n)], "video_id string, frame_number long, ts double")


def test_sampling(spark):
    one = timeline.shot_ids(_frames(spark), F.lit(False))
    s = timeline.shots(one, 10.0)

    def picked(interval=None):
        return sorted(r["frame_number"] for r in timeline.nearest_frames(one, timeline.targets(s, interval)).collect())

    assert picked() == [20] and picked(1.0) == [10, 20, 30] and len(picked(0.001)) <= 40
    for bad in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError):
            timeline.targets(s, bad)


def test_cut(spark):
    two = timeline.shot_ids(_frames(spark), F.col("frame_number") == 20)
    rows = timeline.shots(two, 10.0).orderBy("shot_id").collect()
    assert [(r["start_frame"], r["end_frame"]) for r in rows] == [(0, 20), (20, 40)] and rows[0]["end_seconds"] == 2.0
    got = timeline.nearest_frames(two, timeline.targets(timeline.shots(two, 10.0))).orderBy("frame_number").collect()
    assert [r["frame_number"] for r in got] == [10, 30]


def test_times_that_do_not_rise_fall_back_to_the_frame_rate(spark):
    df = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 0.5), ("v", 2, 0.5)], "video_id string, frame_number long, ts double")
    rows = timeline.usable_times(df, 10.0).orderBy("frame_number").collect()
    assert [r["ts"] for r in rows] == [0.0, 0.1, 0.2] and rows[0]["timestamp_source"] == "frame_rate"
    assert timeline.final_gap(df.limit(1), 10.0).first()["gap"] == pytest.approx(0.1)


def test_percentile_scale_without_spread(spark):
    df = scoring.scale_percentile(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", "y")
    assert {r["y"] for r in df.collect()} == {0.5}


def test_descriptor():
    encode = descriptor.SpatialDescriptor().encode
    for shape in ((1, 1), (1, 30), (30, 1), (4, 4), (10, 900)):
        assert not encode(np.full(shape, 90)).any()
    one = np.zeros((1, 30))
    one[0, 7] = 255
    for g in (one, one.T):
        v = encode(g)
        assert np.isfinite(v).all() and abs(np.linalg.norm(v) - 1) < 1e-5
    scene = np.full((80, 128), 60)
    scene[20:50, 30:80] = 160
    assert encode(scene) @ encode(scene + 20) > 0.999
    assert len(v) == descriptor.SpatialDescriptor().metadata()["dimension"] == 576
    assert descriptor.image_quality(np.full((5, 5), 250))[1:] == (0.0, 1.0)


def test_generated_set(spark):
    labels = synthetic.image_labels(spark, 1)
    pairs = synthetic.preference_pairs(labels)
    assert labels.count() == 96 and labels.select("layout_id").distinct().count() == 8 and pairs.count() == 144
    images = labels.withColumn("geometry", F.col("layout_id"))
    assert evaluation.label_violations(images, pairs).count() == 0
    broken = evaluation.label_violations(images.withColumn("split", F.lit("dev")), pairs)
    assert {r["rule"] for r in broken.collect()} >= {"path outside its split", "pair across splits"}
    one = labels.filter("id = 'dev-000-base-car-warm'").first()
    assert one["path"] == "images/dev/dev-000-base-car-warm.png" and int(one["seed"]) == synthetic.scene_seed(synthetic.SEED, "dev-000-car-warm")


def test_review(spark):
    known = spark.createDataFrame([(10,), (20,)], "frame_number long")

    def problems(*rows):
        return selection.validate_review(spark.createDataFrame(list(rows), "frame_number long, view string, reason string"), known, 3)

    assert problems((10, "a", "b")) == []
    assert problems((10, "a", "b"), (10, "a", "b")) == ["repeated"]
    assert problems((30, "a", "b")) == ["unknown"]
    assert problems() == ["size"]
    assert problems((10, "", None)) == ["unexplained"]


def test_index_resume_corrupt_and_tamper(spark, tmp_path):
    images = tmp_path / "images"
    (images / ".hidden").mkdir(parents=True)
    for i in range(5):
        (images / f"{i}.png").write_bytes(b"bad" if i == 1 else b"P5 4 4 255 " + bytes(range(i, i + 16)))
    (images / "notes.txt").write_text("no image")
    files = media.inventory(spark, str(images))
    assert files.count() == 5
    meta = descriptor.SpatialDescriptor().metadata()
    index = index_store.VectorIndex(spark, str(tmp_path / "index"), meta["dimension"], meta)

    def encode(todo):
        d = media.decode(media.scan(spark, str(images)).join(todo.select(*media.KEY), media.KEY, "left_semi"), media.plain_decoder)
        good = d.filter("error is null").withColumn("vector", descriptor.descriptor_column(F.col("pixels"), F.col("width"), F.col("height")))
        bad = d.filter("error is not null").withColumn("vector", F.lit(None).cast("array<float>"))
        return good.select(*todo.columns, "vector", "error").unionByName(bad.select(*todo.columns, "vector", "error"))

    assert index.extract(files.orderBy("relative_path").limit(2), encode) == 2
    assert index.extract(files, encode) == 3 and index.extract(files, encode) == 0
    manifest = index.build(files, encode)
    assert manifest["counts"] == {"usable": 4, "invalid": 1}
    _, rows, vectors = index.load()
    assert [r["relative_path"] for r in rows.orderBy("id").collect()] == ["0.png", "2.png", "3.png", "4.png"] and vectors.count() == 4
    with pytest.raises(ValueError):
        index_store.VectorIndex(spark, str(tmp_path / "bad"), 3, {}).extract(files, lambda t: t.withColumn("vector", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).cast("array<float>")).withColumn("error", F.lit(None).cast("string")))
    with index_store.locked(str(tmp_path / "index")), pytest.raises(RuntimeError):
        index.load()
    next((tmp_path / "index" / "images").glob("part-*")).write_bytes(b"other")
    with pytest.raises(ValueError):
        index.load()


def test_html_page_has_all_rows(spark):
    page = sinks.render_table("t", spark.range(1500).orderBy("id"))
    assert page.count("<tr>") == 1501 and page.index("<td>0<") < page.index("<td>1499<")


def test_sources_and_sinks(spark, tmp_path):
    for folder in (tmp_path / "missing", tmp_path):
        with pytest.raises(ValueError):
            media.inventory(spark, str(folder))
    with pytest.raises(ValueError):
        index_store.ensure_separate(str(tmp_path), str(tmp_path / "below"))
    target = tmp_path / "x.json"
    sinks.write_json(str(target), {"a": 1})
    with pytest.raises(TypeError):
        sinks.write_json(str(target), {"a": object()})
    assert json.loads(target.read_text()) == {"a": 1}
    sinks.mark_incomplete(str(tmp_path))
    with pytest.raises(ValueError):
        sinks.verify_complete(str(tmp_path))
    sinks.mark_complete(str(tmp_path), "x.json")
    sinks.verify_complete(str(tmp_path))
    page = sinks.render_table("<t>", spark.createDataFrame([("<b>",)], "c string"))
    assert "&lt;b&gt;" in page and "<b>" not in page
    doc = {"shots": [{"id": 1, "queries": [{"frame_number": 7, "timestamp_seconds": 0.7}, {"frame_number": 3, "timestamp_seconds": 0.3}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    schema = "shots array<struct<id:int,queries:array<struct<frame_number:int,timestamp_seconds:double>>>>"
    rows = media.flatten_results(media.read_document(spark, str(tmp_path / "r.json"), schema)).collect()
    assert [(r["shot_id"], r["frame_number"]) for r in rows] == [(1, 3), (1, 7)]
