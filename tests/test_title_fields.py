"""Headers and values of title tables against plain loops."""

import random
import re
import unicodedata

from revlens import catalog
from revlens.operators import titles

ENTITY = "sheet long, ord long, kind string, text string, x double, y double"


def plain_columns(xs):
    xs = sorted(xs)
    steps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
    groups = [[xs[0]]]
    for s, x in zip(steps, xs[1:], strict=True):
        if s > max(steps) * 0.25:
            groups.append([x])
        else:
            groups[-1].append(x)
    return [sum(g) / len(g) for g in groups]


def plain_band(bands):
    if len(bands) < 3:
        return len(bands) - 1
    columns = plain_columns([c[0] for c in bands[0]])
    pitches = sorted(b - a for a, b in zip(columns, columns[1:], strict=False))
    within = pitches[len(pitches) // 2] / 2 if pitches else float("inf")
    ys = [max(c[1] for c in b) for b in bands]
    gaps = [a - b for a, b in zip(ys, ys[1:], strict=False)]
    for i in range(2, len(bands)):
        covered = {min(range(len(columns)), key=lambda k: abs(columns[k] - c[0])) for c in bands[i] if min(abs(k - c[0]) for k in columns) <= within}
        if gaps[i - 1] > max(gaps[: i - 1]) * 2.5 and len(covered) < max(1, len(columns) // 2):
            return i - 1
    return len(bands) - 1


def plain_fields(rows, box):
    """[(key, value, x)] of one sheet."""
    x0, y0, x1, y1 = box
    inside = [(x, y, (t or "").strip(), o) for _, o, kind, t, x, y in rows if kind in titles.TEXTS and x is not None and x0 <= x <= x1 and y0 <= y <= y1]
    inside = [c for c in inside if not ((len(c[2]) <= 1 or re.search(titles.CIRCLED, c[2])) and (c[0] < x0 + 0.08 * (x1 - x0) or c[1] > y1 - 0.08 * (y1 - y0)))]
    inside.sort(key=lambda c: (-c[1], c[3]))
    bands = []
    for c in inside:
        if bands and bands[-1][-1][1] - c[1] <= 4.0:
            bands[-1].append(c)
        else:
            bands.append([c])
    if len(bands) < 2:
        return []
    at = plain_band(bands)
    if at < 1:
        return []
    values = sorted(bands[at], key=lambda c: c[0])
    xs = [c[0] for c in inside]
    reach = max((max(xs) - min(xs) if len(xs) > 1 else 9999.0) / len(values) * 1.5, 30.0)
    out = []
    for x, _, text, _ in values:
        if not text:
            continue
        parts = []
        for band in bands[:at]:
            h = min(band, key=lambda c: abs(c[0] - x))
            if abs(h[0] - x) <= reach and h[2] and h[2] not in parts and not h[2].isdigit():
                parts.append(h[2])
        parts = [p for p in reversed(parts) if p[0] not in "①②③④"]
        out.append((" / ".join(parts) or "Value", text, x))
    return out


def test_fields_as_in_a_loop(spark):
    rng = random.Random(5)
    rows, boxes = [], {}
    words = ["Unit No.", "ユニットNo.", "Part No.", "T. Q'ty", "45", "16組", "①x", "A", "", "①", "note line", "0"]
    for sheet in range(30):
        boxes[sheet] = (0.0, 0.0, 400.0, 300.0)
        k, y = 0, 280.0
        for _ in range(rng.randrange(1, 6)):
            for col in range(rng.choice([1, 2, 4])):
                rows.append((sheet, k, rng.choice(["text", "text", "mtext", "line"]), rng.choice(words), col * 80.0 + rng.choice([10, 10, 12, 50]), y + rng.choice([0.0, 1.0, 2.0])))
                k += 1
            y -= rng.choice([3.0, 9.0, 10.0, 60.0])
    rows += [(40, 1, "text", "lone", 5.0, 5.0), (41, 1, "text", None, None, None), (42, 1, "text", "no box", 5.0, 5.0)]
    boxes |= {40: (0.0, 0.0, 10.0, 10.0), 41: (0.0, 0.0, 1.0, 1.0)}
    b = spark.createDataFrame([(s, *v) for s, v in boxes.items()], "sheet long, xmin double, ymin double, xmax double, ymax double")
    got = {}
    for r in titles.title_fields(spark.createDataFrame(rows, ENTITY).repartition(3), b).orderBy("sheet", "place").collect():
        got.setdefault(r.sheet, []).append((r.key, r.value, r.x))
    want = {s: plain_fields([r for r in rows if r[0] == s], box) for s, box in boxes.items()}
    assert got == {s: v for s, v in want.items() if v} and sum(map(len, got.values())) > 20


def plain_matches(old, new):
    fold = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").strip().lower())
    tokens = lambda key: {fold(p) for p in key.split(" / ") if fold(p)}
    groups = lambda ts: {i for i, g in enumerate(titles.SYNONYMS) if {re.sub(r"[^0-9a-z぀-ヿ一-鿿]", "", t) for t in ts} & set(g)}
    left, out = list(range(len(new))), []
    for i, k in enumerate(old):
        hit = next((j for j in left if tokens(k) & tokens(new[j])), None)
        if hit is None:
            hit = next((j for j in left if groups(tokens(k)) & groups(tokens(new[j]))), None)
        if hit is not None:
            left.remove(hit)
        out.append((i, hit))
    return set(out) | {(None, j) for j in left}


def test_fields_are_matched_in_order(spark):
    rng = random.Random(6)
    heads = ["Unit No.", "ユニットNo.", "Part No.", "ＰＡＲＴ　No.", "コードNo.", "T. Q'ty", "総製作個数", "Map", "在庫棚入庫", "Stock Q'ty", "Value"]
    old, new, want = [], [], set()
    for sheet in range(25):
        a, b = ([" / ".join(rng.sample(heads, rng.choice([1, 1, 2]))) for _ in range(rng.randrange(0, 6))] for _ in range(2))
        old += [(sheet, i, k, f"o{i}") for i, k in enumerate(a)]
        new += [(sheet, i, k, f"n{i}") for i, k in enumerate(b)]
        want |= {(sheet, i, j) for i, j in plain_matches(a, b)}
    frame = lambda rows: spark.createDataFrame(rows, "sheet long, place int, key string, value string")
    got = titles.matched_fields(frame(old), frame(new)).collect()
    assert {(r.sheet, r.old_place, r.new_place) for r in got} == want and len(got) == len(want)
    assert all((r.old_value is None) == (r.old_place is None) for r in got)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    q = catalog.queries()
    fields = q["j15_title_fields"](spark, folder).collect()
    assert len(fields) > 10 and len(q["j14_matched_fields"](spark, folder).collect()) >= 5
