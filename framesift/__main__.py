"""Command line: inspect, synthetic, evaluate-synthetic, index, query, select-frames, replay-selection."""

from __future__ import annotations

import argparse
import json
import math
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import descriptor, evaluation, selection, synthetic
from .plans import frame_selection, video_query
from .session import get_session
from .sources import index_store, media, png, sinks, video


def positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def seconds(text: str) -> float:
    if not (math.isfinite(x := float(text)) and x > 0):
        raise argparse.ArgumentTypeError("must be positive and finite")
    return x


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framesift")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **paths: str | None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for option, default in paths.items():
            c.add_argument(f"--{option}", default=default, required=default is None)
        return c

    command("inspect", images="data/images", output="outputs/inspect")
    c = command("synthetic", output="data/synthetic")
    c.add_argument("--seed", type=int, default=synthetic.SEED)
    c.add_argument("--families-per-split", type=positive, default=12)
    c = command("evaluate-synthetic", dataset="data/synthetic", output="outputs/synthetic")
    c.add_argument("--split", choices=("dev", "test", "all"), default="dev")
    c = command("index", images="data/images", index="artifacts/index")
    c.add_argument("--batch-size", type=positive, default=1 << 20, help="images of one committed round")
    c.add_argument("--descriptor-max-side", type=positive)
    c.add_argument("--rebuild", action="store_true")
    c = command("query", video=None, index="artifacts/index", output="outputs/query")
    c.add_argument("--top-k", type=positive, default=10)
    c.add_argument("--interval-seconds", type=seconds)
    c.add_argument("--threshold", type=seconds, default=video.CUT_SCORE)
    c.add_argument("--min-scene-frames", type=positive, default=video.MIN_SHOT_FRAMES)
    c = command("select-frames", results=None, output=None)
    c.add_argument("--top-k", type=positive, default=17)
    c.add_argument("--min-relevance", type=float, default=0.65)
    c.add_argument("--duplicate", type=float, default=selection.DUPLICATE)
    c.add_argument("--feedback-profile")
    c.add_argument("--review")
    command("replay-selection", selection=None, output=None)
    return p


def inspect(spark: SparkSession, images: str, output: str) -> dict:
    """Decodes every file; the summary covers usable ones. Decoded pixels are not kept, only sizes."""
    found = media.decode(media.scan(spark, images), max_side=1).drop("pixels").persist()
    total = media.summary(found).first()
    if not total["candidates"]:
        raise ValueError(f"no images below {images}")
    good = media.usable(found)
    size = (F.col("source_width").alias("width"), F.col("source_height").alias("height"))
    sinks.write_jsonl(good.select("relative_path", *size, "size_bytes"), f"{output}/images", ["relative_path"])
    sinks.write_jsonl(media.errors(found).select("relative_path", "error"), f"{output}/errors", ["relative_path"])
    summary = {
        "candidate_images": total["candidates"],
        "usable_images": total["usable"],
        "invalid_images": total["invalid"],
        "usable_image_bytes": total["bytes"],
        "extensions": {r["extension"]: r["n"] for r in media.extension_histogram(good).orderBy("extension").collect()},
    }
    sinks.write_json(f"{output}/summary.json", summary)
    return summary


def make_synthetic(spark: SparkSession, output: str, seed: int = synthetic.SEED, families: int = 12, size: tuple[int, int] = synthetic.SIZE) -> dict:
    """Pictures, labels and pairs; the manifest is complete last. Another configuration needs another folder."""
    config = {"generator_version": synthetic.VERSION, "seed": seed, "families_per_split": families, "size": list(size)}
    manifest = Path(output, "manifest.json")
    if manifest.exists():
        if json.loads(manifest.read_text())["config"] != config:
            raise ValueError("another configuration; use a new folder")
    else:
        sinks.empty_folder(output)
    sinks.write_json(str(manifest), {"status": "generating", "config": config})
    labels = synthetic.with_layouts(synthetic.image_labels(spark, families, seed), seed)
    pairs = synthetic.preference_pairs(labels)
    lines = []
    for r in synthetic.rendered(labels, size).orderBy("id").toLocalIterator():  # one picture at a time
        target = Path(output, r["path"])
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(r["content"])
        row = {k: v for k, v in r.asDict(recursive=True).items() if k != "content"}
        lines.append(json.dumps(row | {"seed": int(row["seed"])}, sort_keys=True))
    sinks.write_text(f"{output}/images.jsonl", "\n".join(lines) + "\n")
    listed = [json.dumps(r.asDict(), sort_keys=True) for r in pairs.orderBy("query", "positive", "negative").collect()]
    sinks.write_text(f"{output}/pairs.jsonl", "\n".join(listed) + "\n")
    done = {
        "status": "complete",
        "config": config,
        "image_count": len(lines),
        "layout_count": families * len(synthetic.SPLITS) * len(synthetic.VARIANTS),
        "pair_count": len(listed),
        "files": {n: sinks.sha256_file(f"{output}/{n}") for n in ("images.jsonl", "pairs.jsonl")},
    }
    sinks.write_json(str(manifest), done)
    first = labels.filter(F.col("family_id").isin("dev-000", "test-000")).select("split", "variant", "subject", "appearance", "path").orderBy("split", "variant", "subject", "appearance")
    sinks.write_text(f"{output}/preview.html", sinks.render_gallery("Synthetic scenes", [(r["path"], f"{r['split']} {r['variant']}: {r['subject']}, {r['appearance']}") for r in first.collect()]))
    return done


LABELS = (
    "id string, path string, split string, family_id string, layout_id string, variant string, subject string, appearance string, "
    f"seed decimal(20,0), layout {synthetic.LAYOUT}, sha256 string"
)
PAIRS = "split string, query string, positive string, negative string, change string, positive_change string"


def evaluate(spark: SparkSession, dataset: str, output: str, split: str = "dev", encoder: descriptor.SpatialDescriptor | None = None) -> dict:
    """Checks labels and pictures, then ranks each split's pictures by the descriptor."""
    encoder = encoder or descriptor.SpatialDescriptor(max_side=256)
    labels = media.read_jsonl(spark, f"{dataset}/images.jsonl", LABELS).persist()
    pairs = media.read_jsonl(spark, f"{dataset}/pairs.jsonl", PAIRS)
    manifest = json.loads(Path(dataset, "manifest.json").read_text())
    files = {n: sinks.sha256_file(f"{dataset}/{n}") for n in ("images.jsonl", "pairs.jsonl")}
    problems = evaluation.manifest_violations(manifest, labels, pairs, synthetic.VERSION, files)
    geometry = F.to_json(F.struct("layout"))
    problems += [r["rule"] for r in evaluation.label_violations(labels.withColumn("geometry", geometry), pairs).collect()]
    if problems:
        raise ValueError(f"the labels are not valid: {', '.join(problems)}")
    out = {"descriptor": encoder.metadata(), "dataset_config": manifest["config"], "splits": {}}
    for name, rows in evaluation.split_of(labels, split):
        scanned = media.scan(spark, f"{dataset}/images/{name}").withColumn("path", F.concat(F.lit(f"images/{name}/"), "relative_path"))
        sums = scanned.select("path", F.sha2("content", 256).alias("found"))
        met = rows.select("path", "sha256").join(sums, "path", "full")
        if met.filter("sha256 is null or found is null or sha256 <> found").limit(1).count():
            raise ValueError("pictures differ from the manifest")
        vector = descriptor.descriptor_column(F.col("pixels"), F.col("width"), F.col("height"), encoder)
        vectors = media.decode(scanned).withColumn("path", F.concat(F.lit(f"images/{name}/"), "relative_path")).select("path", vector.alias("embedding"))
        images = rows.select("id", "path", "layout_id").join(vectors, "path").persist()
        rankings, outcomes, preference = evaluation.evaluate_split(images, pairs.filter(F.col("split") == name))
        sinks.write_jsonl(rankings, f"{output}/rankings-{name}", ["query"])
        sinks.write_jsonl(outcomes, f"{output}/pairs-{name}", ["query", "positive", "negative"])
        ordered = images.orderBy("id").select("id", "embedding").toPandas()  # a benchmark's size
        Path(output).mkdir(parents=True, exist_ok=True)
        sinks.write_npy(np.stack(ordered["embedding"].to_numpy()).astype(np.float32), f"{output}/features-{name}.npy")
        means = rankings.agg(*(F.avg(c).alias(c) for c in ("precision_at_10", "top1", "random_expected"))).first().asDict()
        zero = images.filter(V.zero_at_evaluation(F.col("embedding"))).count()
        layouts = images.select("layout_id").distinct().count()
        tables = [r.asDict() for r in preference.orderBy("grouping", "change", "positive_change").collect()]
        out["splits"][name] = means | {"images": len(ordered), "layouts": layouts, "preference": tables, "zero_descriptors": zero}
        page = sinks.render_page(f"{name}: synthetic scenes", [("Lowest margins", sinks.lowest_margins(outcomes))], [f"precision at 10: {means['precision_at_10']:.3f}"])
        sinks.write_text(f"{output}/report-{name}.html", page)
    sinks.write_json(f"{output}/metrics.json", out)
    return out


def encoder_of(scanned: DataFrame, encoder: descriptor.SpatialDescriptor):
    """What VectorIndex asks for: rows of the inventory to checkpoint rows. The files' content is read
    for the wanted rows only."""

    def encode(todo: DataFrame) -> DataFrame:
        rows = media.decode(scanned.join(todo.select(*media.KEY), media.KEY, "left_semi"))
        vector = descriptor.descriptor_column(F.col("pixels"), F.col("width"), F.col("height"), encoder)
        return rows.select(*media.KEY, F.when(F.col("error").isNull(), vector).alias("vector"), "error")

    return encode


def build_index(spark: SparkSession, images: str, index: str, max_side: int | None = None, rebuild: bool = False, batch_rows: int = 1 << 20) -> dict:
    index_store.ensure_separate(images, index)
    encoder = descriptor.SpatialDescriptor(max_side=max_side)
    meta = encoder.metadata()
    files = media.inventory(spark, images).persist()
    store = index_store.VectorIndex(spark, index, meta["dimension"], meta)
    return store.build(files, encoder_of(media.scan(spark, images), encoder), rebuild, batch_rows, lambda: media.inventory(spark, images), images)


def read_anchors(spark: SparkSession, profile: str, encoder: descriptor.SpatialDescriptor) -> DataFrame:
    """A feedback profile's examples with the vectors of their pictures; here one descriptor serves for
    meaning and for layout."""
    described = json.loads(Path(profile).read_text())
    members = media.workbook_media(str(Path(profile).parent / described["workbook"]))
    read = media.default_decoder()

    def vector(member: str | None) -> list[float] | None:
        if member is None:
            return None
        pixels = read(members[member])
        return encoder.encode(png.grey(pixels if pixels.ndim == 3 else pixels[:, :, None])).astype(np.float64).tolist()

    rows = [(e["name"], vector(e["preferred"]), vector(e.get("less_preferred"))) for e in media.feedback_profile(described, set(members))]
    df = spark.createDataFrame(rows, "name string, preferred array<double>, less_preferred array<double>")
    return df.withColumns({"preferred_layout": F.col("preferred"), "less_preferred_layout": F.col("less_preferred")})


def select(spark: SparkSession, results: str, output: str, top_k: int = 17, min_relevance: float = 0.65, duplicate: float = selection.DUPLICATE, profile: str | None = None, review: str | None = None) -> dict:
    source = Path(results).resolve()
    index_store.ensure_separate(str(source.parent), output)
    digest = sinks.sha256_file(str(source))
    data = json.loads(source.read_text())
    if data.get("status") != "complete":
        raise ValueError("the query is not complete")
    media.flatten_results(media.read_document(spark, str(source), video_query.RESULTS))
    manifest, _, vectors = index_store.open_index(spark, data["index"]["path"])
    if index_store.index_digest(manifest) != data["index"]["sha256"]:
        raise ValueError("the results are of another index")
    frames = spark.read.parquet(str(source.parent / "frames")).withColumn("layout", F.col("embedding"))
    if frames.filter(~F.sha2("picture", 256).eqNullSafe(F.col("source_sha256"))).limit(1).count():
        raise ValueError("query frames changed since the query")
    references = vectors.withColumn("layout", F.col("embedding"))
    encoder = descriptor.SpatialDescriptor(**manifest["descriptor"]["parameters"])
    anchors = read_anchors(spark, profile, encoder) if profile else None
    scored = frame_selection.score_candidates(frames, references, anchors, min_relevance).persist()
    provenance = {"results_sha256": digest, "min_relevance": min_relevance}
    if profile:
        book = str(Path(profile).parent / json.loads(Path(profile).read_text())["workbook"])
        provenance["feedback_source"] = {"profile_sha256": sinks.sha256_file(profile), "workbook_sha256": sinks.sha256_file(book)}
    report = frame_selection.write_selection(output, scored, top_k, duplicate=duplicate, extra=provenance)
    trace = selection.select_frames(scored, top_k, duplicate=duplicate)
    sections = [("Decisions", selection.explain(trace).orderBy("step"))]
    if anchors is not None:
        sections.append(("Examples without a frame", frame_selection.unmatched(scored, anchors)))
    if review:
        document = json.loads(Path(review).read_text())
        rows = [(document.get("results_sha256"), r["frame_number"], r.get("view"), r.get("reason")) for r in document.get("selected", [])]
        noted = spark.createDataFrame(rows, "results_sha256 string, frame_number long, view string, reason string").coalesce(1)
        decided = frame_selection.reviewed(selection.dispositions(scored, top_k, duplicate=duplicate), noted, digest, top_k)
        sections.append(("Reviewed", decided.filter("reviewed_rank is not null").orderBy("reviewed_rank")))
    if sinks.sha256_file(str(source)) != digest:
        raise ValueError("the results changed meanwhile")
    target = Path(output).resolve()
    sinks.write_text(str(target.with_name(target.name + "-report.html")), sinks.render_page("Selection", sections))
    return {"selected": len(report["selected"]), "candidates": len(report["inputs"]["frames"])}


def run(a: argparse.Namespace) -> int:
    if a.command == "replay-selection":
        found = frame_selection.replay_folder(str(Path(a.selection).parent if Path(a.selection).is_file() else a.selection), a.output)
    else:
        spark = get_session()
        if a.command == "inspect":
            found = inspect(spark, a.images, a.output)
        elif a.command == "synthetic":
            found = make_synthetic(spark, a.output, a.seed, a.families_per_split)
        elif a.command == "evaluate-synthetic":
            found = evaluate(spark, a.dataset, a.output, a.split)
        elif a.command == "index":
            found = build_index(spark, a.images, a.index, a.descriptor_max_side, a.rebuild, a.batch_size)["counts"]
        elif a.command == "query":
            found = video_query.run(spark, a.video, a.index, a.output, a.top_k, a.interval_seconds, a.threshold, a.min_scene_frames)
        else:
            found = select(spark, a.results, a.output, a.top_k, a.min_relevance, a.duplicate, a.feedback_profile, a.review)
    print(json.dumps(found, indent=2))
    return 1 if found.get("usable_images") == 0 else 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
