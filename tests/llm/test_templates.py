"""Decontamination against plain Python: generated questions, the same with other numbers, names and units, and texts that only look like them."""

import random
import re

from quotelens.llm import decontamination
from quotelens.llm.decontamination import NUMBERS, UNITS, Templates

NAMES = "Tom James Anna Mia Karl Lena Ravi Sofia Omar Chen".split()
THINGS = "apples marbles books coins stamps pencils shells cards".split()
FORMS = [
    "{a} bought {n} {t} at the old market. {a} gave {m} of them to {b}. How many {t} does {a} have now?",
    "If {a} has {n} {t} and {b} takes {m} away, how many are left in the box at the end of the day?",
    "A train covers {n} {u} in the morning and {m} {u} after lunch, and then it stands still. How far did it go in all?",
    "{a} runs {n} {u} every morning before school, while {b} runs only {m}. Who of the two runs further in one week?",
    "There are {n} red {t} and {m} green ones in the bag that {a} carries. What part of all the {t} is red?",
    "{a} and {b} share {n} {t} so that one of them gets {m} more. How many does each get?",
]
FILLER = [f"f{i}" for i in range(400)]
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*")


def canonical(text):
    words, out = WORD.findall(text or ""), []
    number = lambda w: w[0].isdigit() or w.lower() in NUMBERS
    for before, w in zip(["", *words], words):
        slot = "#n" if number(w) else "#u" if w.lower() in UNITS and before and number(before) else "#p" if len(w) > 1 and w[0].isupper() and w[1].islower() else None
        out.append((slot or w.lower(), w.lower() if slot else None))
    return out


def windows(words, n):
    """Place, template and values of each window; in the template a value carries how far back its last use is."""
    for i in range(len(words) - n + 1):
        part = words[i : i + n]
        back = [next((d for d in range(1, k + 1) if v is not None and part[k - d][1] == v), 0) for k, (_, v) in enumerate(part)]
        values = [v for _, v in part if v is not None]
        yield i, (tuple(values) if len(values) == n else tuple((t, d) for (t, _), d in zip(part, back))), values


def brute(docs, items, templates):
    found = set()
    for j, item in items:
        words = canonical(item)
        n = min(len(words), templates.window)
        if not words:
            continue
        own = list(windows(words, n))
        of_kind = {"windows": {i for i, *_ in own}, "worded": {i for i, _, v in own if len(v) < n}, "strong": {i for i, _, v in own if n - len(v) >= min(n, templates.literal)}}
        for d, text in docs:
            shifts = {}
            for at, template, values in windows(canonical(text), n):
                for i, wanted, item_values in own:
                    if template == wanted:
                        shifts.setdefault(at - i, []).append((i, values, item_values))
            counted = set()
            for matched in shifts.values():
                pairs = lambda some: {p for _, a, b in some for p in zip(a, b)}
                fits = lambda some: len({a for a, _ in pairs(some)}) == len(pairs(some)) == len({b for _, b in pairs(some)})
                strong = [m for m in matched if m[0] in of_kind["strong"]]
                places = {m[0] for m in matched}
                literals = {k for i in places for k in range(i, i + n) if words[k][1] is None}
                aligned = len(literals) + sum(a == b for a, b in pairs(matched))
                if fits(matched) and (aligned >= templates.literal or of_kind["worded"] <= places and aligned >= templates.few):
                    counted |= places
                else:
                    counted |= ({m[0] for m in strong} if fits(strong) else set()) | {i for i, a, b in matched if i not in of_kind["strong"] and a == b}
            if any(counted & kind and len(counted & kind) >= templates.cover * len(kind) for kind in of_kind.values()):
                found.add((d, j))
    return found


def filled(rng, form, words=False):
    a, b = rng.sample(NAMES, 2)
    n, m = rng.sample(range(2, 13), 2)
    number = lambda k: NUMBERS[k] if words else str(k)
    return form.format(a=a, b=b, n=number(n), m=number(m), u=rng.choice(["km", "miles", "meters"][: 2 if words else 3]), t=rng.choice(THINGS))


def test_equals_brute_force_and_finds_other_values(spark):
    rng = random.Random(11)
    noise = lambda n: " ".join(rng.choice(FILLER) for _ in range(n))
    items = [(i, filled(rng, form, i % 2 == 0)) for i, form in enumerate(FORMS)] + [(90, "Short one"), (91, "4 5 6"), (92, None), (93, "x " * 30)]
    docs, want = [], set()
    for d in range(90):
        i = d % len(FORMS)
        thing = next((t for t in THINGS if t in items[i][1].split()), None)
        form = FORMS[i].replace("{t}", thing or "{t}")  # things are words of the question, names and numbers are not
        text = filled(rng, form, rng.random() < 0.5)
        if d % 3 == 2:  # the words of the question, in another order
            words = text.split()
            rng.shuffle(words)
            docs.append((d, f"{noise(20)} {' '.join(words)} {noise(5)}"))
        else:
            docs.append((d, f"{noise(rng.randint(0, 30))}. {text} {noise(rng.randint(0, 30))}"))
            want.add((d, i))
    docs += [(200, None), (201, ""), (202, "x " * 4000), (203, "Short one, short One."), (204, "4 5 6 7"), (205, "5 6 7")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "question")
    # columns of both tables that have the names of others
    frames = frames[0].selectExpr("*", "1 as item_id", "'a' as words", "2 as shift"), frames[1].selectExpr("*", "1 as doc_id", "'b' as hash")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(*frames, item_text="question").collect()}
    assert got == brute(docs, items, Templates())
    recall = len(got & want) / len(want)
    assert recall >= 0.9, recall
    assert not {d for d, _ in got} & {d for d in range(90) if d % 3 == 2}
