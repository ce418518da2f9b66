"""Reference-guided selection as one dataflow: matches, references, feedback, scores, decisions.

Candidates are frames (video_id, frame_number, embedding, layout, sharpness, dark_fraction,
bright_fraction); references an index (id, embedding, layout); anchors examples (name, preferred,
preferred_layout, less_preferred, less_preferred_layout; the last two null where there is none).
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn, scoring, selection
from ..sources import sinks

#: Version of the decisions, and the shortlist of references for each frame.
VERSION = "reference-quality-diversity-v2"
SHORTLIST = 64
ID = ["video_id", "frame_number"]


def reference_scores(frames: DataFrame, references: DataFrame, limit: int = scoring.REFERENCE_LIMIT, duplicate: float = scoring.REFERENCE_DUPLICATE) -> tuple[DataFrame, DataFrame]:
    """(each frame's distinct references, their means): relevance_raw, layout_raw and
    distinct_reference_count by id of `frames` (id, embedding, layout)."""
    matches = knn.top_k(frames.select("id", "embedding"), references.select("id", "embedding"), min(SHORTLIST, references.count())).drop("rank")
    shortlist = matches.join(references.select(F.col("id").alias("image_id"), "embedding"), "image_id")
    kept = scoring.distinct_references(shortlist, limit, duplicate)
    met = kept.join(references.select(F.col("id").alias("image_id"), F.col("layout").alias("reference_layout")), "image_id")
    met = met.join(frames.select(F.col("id").alias("query_id"), "layout"), "query_id")
    met = met.withColumn("layout_similarity", V.dot(F.col("layout"), F.col("reference_layout")))
    means = met.groupBy("query_id").agg(
        F.avg("score").alias("relevance_raw"), F.avg("layout_similarity").alias("layout_raw"), F.count(F.lit(1)).alias("distinct_reference_count")
    )
    return kept, means


def feedback_scores(frames: DataFrame, anchors: DataFrame, floor: float = scoring.FEEDBACK_FLOOR, margin: float = scoring.FEEDBACK_MARGIN) -> DataFrame:
    """id, seed_group (the assigned anchor's name, or null) and feedback of `frames` (id, embedding,
    layout). Anchors are a user's examples, a few; they are numbered by name."""
    listed = anchors.withColumn("anchor", F.row_number().over(Window.orderBy("name")).cast("int") - 1)
    met = frames.join(F.broadcast(listed))
    similar = met.select(F.col("id").alias("row"), "anchor", V.dot(F.col("embedding"), F.col("preferred")).alias("similarity"))
    found = scoring.assign_feedback(similar, floor, margin).filter("anchor >= 0").withColumnRenamed("row", "id")
    rows = frames.join(found, "id", "left").join(F.broadcast(listed), "anchor", "left")

    def gap(own: str, a: str, b: str):
        return V.dot(F.col(own), F.col(a)) - V.dot(F.col(own), F.col(b))

    pair = scoring.pair_feedback(gap("embedding", "preferred", "less_preferred"), gap("layout", "preferred_layout", "less_preferred_layout"))
    alone = scoring.positive_feedback(V.dot(F.col("layout"), F.col("preferred_layout")))
    score = F.when(F.col("name").isNull(), F.lit(scoring.NO_FEEDBACK)).when(F.col("less_preferred").isNull(), alone).otherwise(pair)
    return rows.select("id", F.col("name").alias("seed_group"), score.alias("feedback"))


def score_candidates(candidates: DataFrame, references: DataFrame, anchors: DataFrame | None = None, min_relevance: float = scoring.MIN_RELEVANCE, weights: dict[str, float] | None = None) -> DataFrame:
    """candidates with relevance_raw, the four components, score, eligible and seed_group."""
    if not 0 <= min_relevance <= 1:
        raise ValueError("the least relevance must be from 0 to 1")
    selection.check_weights(weights or scoring.WEIGHTS)
    frames = candidates.withColumn("id", F.xxhash64(*ID))
    _, means = reference_scores(frames, references)
    rows = frames.join(means.withColumnRenamed("query_id", "id"), "id")
    if anchors is None:
        rows = rows.withColumns({"seed_group": F.lit(None).cast("string"), "feedback": F.lit(scoring.NO_FEEDBACK)})
    else:
        rows = rows.join(feedback_scores(frames, anchors), "id")
    scored = scoring.components(rows, min_relevance, by="video_id").withColumn("score", scoring.weighted_score(weights))
    return scored.withColumn("seed_group", F.when(F.col("eligible"), F.col("seed_group"))).drop("id")


def unmatched(scored: DataFrame, anchors: DataFrame) -> DataFrame:
    """video_id, name of anchors that no eligible candidate of a video was assigned to."""
    wanted = scored.select("video_id").distinct().join(F.broadcast(anchors.select("name")))
    had = scored.filter("seed_group is not null").select("video_id", F.col("seed_group").alias("name")).distinct()
    return wanted.join(had, ["video_id", "name"], "left_anti")


def reviewed(decided: DataFrame, review: DataFrame, results_sha256: str, count: int) -> DataFrame:
    """Candidates with the reviewer's view and reason joined on. The review (results_sha256, frame_number,
    view, reason) must name exactly these results, and known frames, once each, with reasons."""
    if review.filter(~F.col("results_sha256").eqNullSafe(F.lit(results_sha256))).limit(1).count():
        raise ValueError("the review is of other results")
    if problems := selection.validate_review(review, decided, count):
        raise ValueError(f"the review is not valid: {', '.join(problems)}")
    order = F.row_number().over(Window.orderBy("place"))  # as many rows as a selection has
    rank = review.withColumn("place", F.monotonically_increasing_id()).withColumn("reviewed_rank", order).drop("place", "results_sha256")
    return decided.join(rank, "frame_number", "left")


def write_selection(folder: str, candidates: DataFrame, count: int = 17, penalty: float = selection.PENALTY, duplicate: float = selection.DUPLICATE, weights: dict[str, float] | None = None, extra: dict | None = None) -> dict:
    """Decide for one video (frame_number, score, eligible, embedding[, seed_group, components, picture]) and
    write what replay needs: inputs, similarities, trace, dispositions, audit tables, the selected
    pictures if given, and last the status."""
    sinks.empty_folder(folder)
    sinks.mark_incomplete(folder)
    p = candidates.orderBy("frame_number").limit(selection.MAX_CANDIDATES + 1).toPandas()
    if not 1 <= len(p) <= selection.MAX_CANDIDATES or candidates.select("video_id").distinct().count() != 1:
        raise ValueError(f"one video with 1 to {selection.MAX_CANDIDATES} candidates is needed")
    vectors = np.stack(p["embedding"].to_numpy()).astype(float)
    similarity = selection.similarity_matrix(vectors)
    groups = selection.seed_groups(p)
    items = [(int(f), b) for f, b in zip(p["frame_number"], p["picture"], strict=True)] if "picture" in p else []
    inputs = {
        "frames": [int(x) for x in p["frame_number"]],
        "scores": [float(x) for x in p["score"]],
        "eligible": [bool(x) for x in p["eligible"]],
        "count": count,
        "seed_groups": [[name, rows] for name, rows in groups],
        "penalty": penalty,
        "duplicate": duplicate,
    }
    chosen, trace, ds = selection.rank_candidates(inputs["frames"], inputs["scores"], inputs["eligible"], similarity, count, groups, penalty, duplicate)
    sinks.write_npy(vectors.astype(np.float32), f"{folder}/frame-embeddings.npy")
    sinks.write_npy(similarity, f"{folder}/frame-similarities.npy")
    pd.DataFrame([{k: v for k, v in step.items() if k in ("step", "phase", "feedback_example", "winner")} | row for step in trace for row in step["pool"]]).drop(
        columns=["row"], errors="ignore"
    ).to_csv(f"{folder}/decision-trace.csv", index=False)
    scores = p.drop(columns=[c for c in p if isinstance(p[c].iloc[0], (list, np.ndarray, bytes))])
    scores.assign(automatic_status=[d["status"] for d in ds], selected_rank=pd.array([d["step"] for d in ds], "Int64")).to_csv(f"{folder}/candidate-scores.csv", index=False)
    if items:
        sinks.export_pictures([items[i] for i in chosen], folder)
    report = (extra or {}) | {
        "version": VERSION,
        "inputs": inputs,
        "weights": weights or scoring.WEIGHTS,
        "selected": chosen,
        "trace": trace,
        "dispositions": ds,
        "review": None,
        "decision_code_sha256": _code(),
        "files": sinks.file_digests(folder, ("status.json",)),
    }
    sinks.write_json(f"{folder}/selection.json", report)
    sinks.mark_complete(folder, "selection.json")
    return report


def _code() -> str:
    return hashlib.sha256(Path(selection.__file__).read_bytes()).hexdigest()


def replay_folder(folder: str, output: str) -> dict:
    """Decide again from what write_selection() froze, and write the same folder anew. Anything that isn't
    as recorded is an error: status, version, code, files, decisions, reasons."""
    a, b = Path(folder).resolve(), Path(output).resolve()
    if a == b or a in b.parents or b in a.parents:
        raise ValueError("source and output must not contain each other")
    sinks.empty_folder(output)
    sinks.verify_complete(folder)
    report = json.loads(Path(folder, "selection.json").read_text())
    if report.get("version") != VERSION or report.get("review") is not None:
        raise ValueError("only an automatic selection of this version can be replayed")
    if report["decision_code_sha256"] != _code():
        raise ValueError("the decision code changed")
    if any(".." in Path(n).parts or Path(n).is_absolute() for n in report["files"]):
        raise ValueError("a file is outside the folder")
    if report["files"] != sinks.file_digests(folder, ("status.json", "selection.json")):
        raise ValueError("files of the selection changed")
    i = report["inputs"]
    similarity = sinks.read_npy(f"{folder}/frame-similarities.npy")
    chosen, trace, ds = selection.rank_candidates(i["frames"], i["scores"], i["eligible"], similarity, i["count"], [tuple(g) for g in i["seed_groups"]], i["penalty"], i["duplicate"])
    if (chosen, trace, ds) != (report["selected"], report["trace"], report["dispositions"]):
        raise ValueError("other decisions than recorded")
    sinks.mark_incomplete(output)
    for name in report["files"]:
        target = Path(output, name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(Path(folder, name).read_bytes())
    sinks.write_json(f"{output}/selection.json", report | {"replay": {"source_sha256": sinks.sha256_file(f"{folder}/selection.json"), "identical": True}})
    sinks.mark_complete(output, "selection.json")
    return {"selected": len(chosen), "identical": True}
