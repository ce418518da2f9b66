"""Sinks: atomic JSON, JSON lines, audit CSV, HTML, status markers."""

from __future__ import annotations

import hashlib
import html
import json
import os
import shutil
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame


def write_text(path: str, text: str) -> None:
    """Replace the file as a whole; on failure the old one stays."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w") as f:
            f.write(text)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def write_json(path: str, value: object) -> None:
    write_text(path, json.dumps(value, indent=2) + "\n")


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as JSON lines; in one ordered file if an order is given."""
    (df.orderBy(*order).coalesce(1) if order else df).write.mode("overwrite").json(path)


def write_audit_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_npy(array: np.ndarray, path: str) -> None:
    """An array without pickled objects, as a whole or not at all."""
    staged = f"{path}.staged"
    with open(staged, "wb") as f:
        np.save(f, array, allow_pickle=False)
    os.replace(staged, path)


def read_npy(path: str) -> np.ndarray:
    return np.load(path, allow_pickle=False)


def export_selected(items: list[tuple[int, str, str]], folder: str) -> list[str]:
    """Copies of (frame number, source file, its sha256) in rank order as selected/RR-frame-NNNNNNNN.ext,
    and all of them in selected-frames.zip. A file that changed since is an error."""
    os.makedirs(f"{folder}/selected", exist_ok=True)
    names = []
    for rank, (frame, source, digest) in enumerate(items, 1):
        name = f"selected/{rank:02d}-frame-{frame:08d}{Path(source).suffix.lower()}"
        shutil.copyfile(source, f"{folder}/{name}")
        if sha256_file(f"{folder}/{name}") != digest:
            raise ValueError(f"frame {frame} changed during selection")
        names.append(name)
    with zipfile.ZipFile(f"{folder}/selected-frames.zip", "w") as z:
        for name in names:
            z.write(f"{folder}/{name}", Path(name).name)
    return names


def export_pictures(items: list[tuple[int, bytes]], folder: str) -> list[str]:
    """export_selected() of (frame number, PNG) in rank order."""
    with tempfile.TemporaryDirectory() as d:
        given = []
        for frame, content in items:
            path = Path(d, f"{frame}.png")
            path.write_bytes(content)
            given.append((frame, str(path), hashlib.sha256(content).hexdigest()))
        return export_selected(given, folder)


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> int:
    """The files of a frame, one row at a time, under the relative paths in column `name`."""
    n = 0
    for r in rows.toLocalIterator():
        target = Path(folder, r[name])
        if ".." in target.parts:
            raise ValueError(f"{r[name]} leaves its folder")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(r[content])
        n += 1
    return n


def file_digests(folder: str, leave_out: tuple[str, ...] = ()) -> dict[str, str]:
    """sha256 of every file below the folder, by relative path."""
    paths = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    return {n: sha256_file(str(p)) for p in paths if (n := p.relative_to(folder).as_posix()) not in leave_out}


def empty_folder(folder: str) -> None:
    """A new or empty folder to write to; anything in it is an error."""
    os.makedirs(folder, exist_ok=True)
    if any(Path(folder).iterdir()):
        raise ValueError(f"{folder} is not empty")


def mark_incomplete(folder: str) -> None:
    write_json(f"{folder}/status.json", {"status": "incomplete"})


def mark_complete(folder: str, result: str) -> None:
    write_json(f"{folder}/status.json", {"status": "complete", "result": result, "sha256": sha256_file(f"{folder}/{result}")})


def verify_complete(folder: str) -> None:
    s = json.loads(Path(folder, "status.json").read_text())
    if s.get("status") != "complete" or sha256_file(f"{folder}/{s['result']}") != s["sha256"]:
        raise ValueError(f"{folder} holds no complete result")


def render_table(title: str, df: DataFrame) -> str:
    """A frame as an HTML page, all rows; every cell is escaped."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.toLocalIterator())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>\n"


def image_link(path: str) -> str:
    """A relative file path as the address of a picture in a page."""
    return quote(path.replace(os.sep, "/"), safe="/.")


def render_page(title: str, sections: list[tuple[str, DataFrame]], notes: list[str] = ()) -> str:
    """Titled tables under one heading, with notes first; all rows, everything escaped."""
    body = "".join(f"<p>{html.escape(n)}</p>" for n in notes)
    for name, df in sections:
        page = render_table(name, df)
        body += f"<h2>{html.escape(name)}</h2>" + page[page.index("<table>") :]
    return f"<!doctype html><html lang='en'><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}</html>\n"


def render_gallery(title: str, pictures: list[tuple[str, str]]) -> str:
    """A page of pictures (relative path, caption)."""
    body = "".join(f"<figure><img src='{image_link(p)}' alt=''><figcaption>{html.escape(c)}</figcaption></figure>" for p, c in pictures)
    return f"<!doctype html><html lang='en'><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}</html>\n"


def lowest_margins(pairs: DataFrame, n: int = 12) -> DataFrame:
    return pairs.orderBy("margin", "query", "negative").limit(n)
