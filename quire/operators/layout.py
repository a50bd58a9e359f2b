"""Operators over one page, unit or reply at a time: grouping of recognised words, splitting a reply over its lines, wrapping and fitting.

Sizes are bounded by a page or a unit, never by the table. ``per_key`` streams the sorted rows of one key after another
through a plain function; the others are functions of one row, applied in Arrow batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values.
#: Characters that never begin a line of Chinese text.
NO_LINE_START = "，。；：？！、）》」』”’…"
RECENT_LINES, SAME_LINE, WORD_GAP, WORD_GAP_LEAST = 12, 0.45, 2.4, 18.0
COLUMN_STEP, LINE_SHIFT, LINE_GAP, LINE_GAP_LEAST, LINE_BACK, SIZE_CHANGE = 30.0, 18.0, 0.9, 1.6, 0.35, 0.45
FIT_STEP, FIT_SLACK, LINE_PITCH = 0.5, 0.5, 1.15
#: Width of a character by its kind, in font sizes: a table in place of a font.
NARROW, WIDE = 0.5, 1.0


def per_key(rows: DataFrame, key: str, order: list[str], apply: Callable[[list[dict]], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows that ``apply`` makes of all rows of each key, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for i in range(0, batch.num_rows, 4096) for row in batch.slice(i, 4096).to_pylist())
        for _, group in itertools.groupby(each, lambda row: row[key]):
            if out := apply(list(group)):
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


# --- recognised words -----------------------------------------------------------------------------


def ocr_lines(words: list[tuple]) -> list[dict]:
    """Lines (box, text) of words (x0, y0, x1, y1, text): a word joins that one of the last lines beside it which it overlaps most."""
    words = sorted(((x0, y0, x1, y1, t.strip()) for x0, y0, x1, y1, t in words if t and t.strip() and x1 > x0 and y1 > y0), key=lambda w: (w[1], w[0]))
    boxes, members = np.zeros((len(words), 4)), []
    for word in words:
        x0, y0, x1, y1, _ = word
        n = len(members)
        first = max(0, n - RECENT_LINES)
        near = boxes[first:n]
        shorter = np.minimum(near[:, 3] - near[:, 1], y1 - y0)
        shared = np.minimum(near[:, 3], y1) - np.maximum(near[:, 1], y0)
        apart = np.maximum(x0 - near[:, 2], near[:, 0] - x1)
        shared[(shared <= 0) | (apart > np.maximum(WORD_GAP * shorter, WORD_GAP_LEAST))] = 0
        best = int(shared.argmax()) if n else -1
        if n and shared[best] > 0 and shared[best] >= SAME_LINE * shorter[best]:
            at = first + best
            boxes[at] = *np.minimum(boxes[at, :2], (x0, y0)), *np.maximum(boxes[at, 2:], (x1, y1))
            members[at].append(word)
        else:
            boxes[n] = word[:4]
            members.append([word])
    lines = [{"box": tuple(map(float, box)), "text": " ".join(w[4] for w in sorted(own, key=lambda w: w[0]))} for box, own in zip(boxes[: len(members)], members, strict=True)]
    return sorted(lines, key=lambda x: (round(x["box"][1], 1), x["box"][0]))


def columns_of(lines: list[dict]) -> list[list[dict]]:
    """Lines by column, in reading order: a step of the left edges opens one; columns go by their first line."""
    out: list[list[dict]] = []
    left = None
    for line in sorted(lines, key=lambda x: x["box"][0]):
        if left is None or abs(line["box"][0] - left) > COLUMN_STEP:
            out.append([])
        out[-1].append(line)
        left = line["box"][0]
    for column in out:
        column.sort(key=lambda x: (x["box"][1], x["box"][0]))
    return sorted(out, key=lambda c: (round(c[0]["box"][1], 1), min(x["box"][0] for x in c)))


def goes_on(a: tuple, b: tuple, between: list[tuple]) -> bool:
    """Whether the line of box ``b`` goes on with the paragraph of ``a``: near below it, of its height and left edge, nothing between."""
    tall, tall_b = a[3] - a[1], b[3] - b[1]
    least, gap = max(1.0, min(tall, tall_b)), b[1] - a[3]
    alike = -LINE_BACK * least <= gap <= max(LINE_GAP_LEAST, LINE_GAP * least) and abs(tall - tall_b) <= SIZE_CHANGE * max(tall, tall_b) and abs(b[0] - a[0]) <= LINE_SHIFT
    return alike and not any(c[1] >= a[3] - 1 and c[3] <= b[1] + 1 and c[2] > min(a[0], b[0]) and c[0] < max(a[2], b[2]) for c in between)


def join_words(lines: list[str]) -> str:
    """The text of a paragraph's lines: a single hyphen before a small letter goes, with the blank."""
    out = ""
    for line in filter(None, map(str.strip, lines)):
        hyphen = out.endswith("-") and not out.endswith("--") and line[0].islower()
        out = out[:-1] + line if hyphen else f"{out} {line}" if out else line
    return out


def page_units(words: list[tuple], sent: Callable[[str], bool]) -> list[str]:
    """The texts to send of one page of recognised words: paragraphs of the lines that ``sent`` accepts."""
    lines = ocr_lines(words)
    for line in lines:
        line["sent"] = sent(line["text"])
    between, out = [x["box"] for x in lines if not x["sent"]], []
    for column in columns_of([x for x in lines if x["sent"]]):
        paragraph: list[dict] = []
        for line in column:
            if paragraph and not goes_on(paragraph[-1]["box"], line["box"], between):
                out.append(join_words([x["text"] for x in paragraph]))
                paragraph = []
            paragraph.append(line)
        out.append(join_words([x["text"] for x in paragraph]))
    return [x for x in out if x]


# --- a reply over its lines -----------------------------------------------------------------------


def _in_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "-'")


def split_reply(reply: str, widths: list[float]) -> list[str]:
    """A unit's reply over its lines by their widths: a character a line at least, no word cut; one too short for that goes to the widest line."""
    n, size = len(widths), len(reply)
    if n <= 1:
        return [reply] * n
    if size < n:
        widest = max(range(n), key=lambda k: (widths[k], -k))
        return [reply if k == widest else "" for k in range(n)]
    total = float(sum(widths))
    share = np.array(widths, float) / total * (size - n) if total else np.full(n, (size - n) / n)
    whole = np.floor(share).astype(int)
    # the characters left over go to the largest remainders, then to the wider lines, then to the first
    for k in sorted(range(n), key=lambda k: (share[k] - whole[k], widths[k], -k), reverse=True)[: size - n - int(whole.sum())]:
        whole[k] += 1
    # every cut is at its wanted place, or at the last border of words before it, behind the cut before
    cuts = [0]
    for k, cut in enumerate(np.cumsum(whole + 1)[:-1].tolist(), 1):
        while cut > cuts[-1] + 1 and _in_word(reply[cut - 1]) and _in_word(reply[cut]):
            cut -= 1
        cuts.append(min(max(cut, cuts[-1] + 1), size - (n - k)))
    return [reply[a:b].strip() for a, b in itertools.pairwise([*cuts, size])]


def absorb(units: list[tuple[list[int], list[float], str | None]]) -> dict[int, str | None]:
    """Line -> its part of the reply; None where the line is covered only. Units of an empty reply keep their lines as they are."""
    out: dict[int, str | None] = {}
    for lines, widths, reply in units:
        if reply := (reply or "").strip():
            out.update(zip(lines, (part or None for part in split_reply(reply, widths)), strict=True))
    return out


# --- wrapping and fitting -------------------------------------------------------------------------


def text_width(text: str, size: float) -> float:
    """Width of a text by the table of kinds of characters."""
    return size * sum(WIDE if ord(c) >= 0x2E80 else NARROW for c in text)


def wrap(text: str, size: float, width: float) -> list[str]:
    """Lines of a text, greedily: words stay whole where they fit, any longer run breaks between characters; closing marks hang behind a line."""
    words = [w for w in text.replace("\r", "").replace("\n", " ").split(" ") if w]
    lines, line, used = [], "", 0.0

    def close() -> None:
        nonlocal line, used
        if line.strip():
            lines.append(line.rstrip())
        line, used = "", 0.0

    for word in words:
        blank = text_width(" ", size) if line else 0.0
        if text_width(word, size) <= width:
            if line and used + blank + text_width(word, size) > width:
                close()
                blank = 0.0
            line, used = (f"{line} {word}" if line else word), used + blank + text_width(word, size)
            continue
        line, used = (line + " " if line else line), used + blank
        for c in word:
            if line and used + text_width(c, size) > width:
                close()
            line, used = line + c, used + text_width(c, size)
    close()
    out: list[str] = []
    for line in lines:
        while line and out and line[0] in NO_LINE_START and text_width(out[-1] + line[0], size) <= width + 1.2 * size:
            out[-1], line = out[-1] + line[0], line[1:]
        if line:
            out.append(line)
    return out or [""]


def fit(text: str, width: float, height: float, largest: float, least: float = 4.0) -> float:
    """The largest size, by steps of a half from ``largest``, whose lines fit the height; a single line fits always."""
    size = largest
    while size >= least:
        lines = wrap(text, size, width)
        if len(lines) == 1 or len(lines) * size * LINE_PITCH <= height + FIT_SLACK:
            return size
        size -= FIT_STEP
    return least


def fit_paragraph(texts: list[str], sizes: list[float], width: float, height: float, least: float = 4.0) -> tuple[float, int]:
    """Shrink factor, and how many texts from the first on fit the height: all at the largest factor that allows it, else the longest prefix at the least."""
    for twentieth in range(20, 11, -1):
        factor, used, n = twentieth / 20, 0.0, 0
        for text, own in zip(texts, sizes, strict=True):
            size = max(least, own * factor)
            used += len(wrap(text, size, width)) * size * LINE_PITCH
            if used > height:
                break
            n += 1
        if n == len(texts):
            return factor, n
    return factor, n
