"""Alignment of word sequences whose words may differ in spelling: the only functions that run in Python workers.

Each takes columns of word arrays and works on Arrow batches. Equality of words isn't transitive, so no key for it exists
that a join could use; callers find the pairs to align by joins on exact words first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

#: How many words of either side may be written as one, in order of preference: (canon, citation).
STEPS = ((1, 1), (1, 2), (1, 3), (2, 1), (3, 1))


def _same(drift: str):
    letters = frozenset(drift)

    def same(a: str, b: str) -> bool:
        if a == b:
            return True
        if not letters or abs(len(a) - len(b)) > 2:
            return False
        if len(a) == len(b):
            differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
            return len(differ) == 1 and letters.issuperset(differ[0])
        short, long = sorted((a, b), key=len)
        rest = {long}
        for _ in range(len(long) - len(short)):
            rest = {w[:i] + w[i + 1 :] for w in rest for i, c in enumerate(w) if c in letters}
        return short in rest

    return same


def end_of_alignment(canon: list[str], cited: list[str], start: int, same) -> int:
    """Where the words of canon from start that write all of cited end, or -1."""
    dead = set()

    def go(h: int, n: int) -> int:
        if n == len(cited):
            return h
        if (h, n) in dead:
            return -1
        for take_h, take_n in STEPS:
            if h + take_h <= len(canon) and n + take_n <= len(cited) and same("".join(canon[h : h + take_h]), "".join(cited[n : n + take_n])):
                if (end := go(h + take_h, n + take_n)) >= 0:
                    return end
        dead.add((h, n))
        return -1

    return go(start, 0)


def first_alignment(canon: list[str], cited: list[str], same, begin: int = 0) -> tuple[int, int] | None:
    for start in range(begin, len(canon)):
        if (end := end_of_alignment(canon, cited, start, same)) >= 0:
            return start, end
    return None


def distances(a: list[str], b: list[str], same, free: bool, budget: int | None = None) -> list[list[int]]:
    """Edit distances of prefixes of a and b; free: a may begin anywhere in b. It ends early, with a row above budget, where none can be within."""
    table = [[0 if free else j for j in range(len(b) + 1)]]
    for i, word in enumerate(a, 1):
        row = [i]
        for j, other in enumerate(b, 1):
            row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (not same(word, other))))
        table.append(row)
        if budget is not None and min(row) > budget:
            break
    return table


def trace(cited: list[str], window: list[str], same) -> list[dict]:
    """The edits from cited to window; where several are best, words are paired first, then cited words are extra."""
    table, out = distances(cited, window, same, False), []
    i, j = len(cited), len(window)
    while i or j:
        here = table[i][j]
        if i and j and here == table[i - 1][j - 1] + (not same(cited[i - 1], window[j - 1])):
            i, j = i - 1, j - 1
            out.append({"op": "keep" if here == table[i][j] else "sub", "cited": cited[i], "authentic": window[j]})
        elif i and here == table[i - 1][j] + 1:
            i -= 1
            out.append({"op": "extra", "cited": cited[i], "authentic": None})
        else:
            j -= 1
            out.append({"op": "missing", "cited": None, "authentic": window[j]})
    return out[::-1]


def soft_span(drift: str):
    """(canon, cited) -> start and end of the first run of canon that writes cited, or null."""
    same = _same(drift)

    @F.pandas_udf("start int, end int")
    def span(canon: pd.Series, cited: pd.Series) -> pd.DataFrame:
        found = [first_alignment(list(h), list(n), same) if h is not None and n is not None and len(n) else None for h, n in zip(canon, cited, strict=True)]
        return pd.DataFrame({"start": [f[0] if f else None for f in found], "end": [f[1] if f else None for f in found]}).astype("Int32")

    return span


def longest_run(drift: str):
    """(canon, typed) -> first word and length of the longest run of canon that agrees, word for word, with the beginning of typed; the first of equal ones, null if there is none."""
    same = _same(drift)

    def of(canon: list[str], typed: list[str]) -> tuple[int, int] | None:
        best = None
        for start in range(len(canon)):
            n = 0
            while n < len(typed) and start + n < len(canon) and same(canon[start + n], typed[n]):
                n += 1
            if n and (best is None or n > best[1]):
                best = (start, n)
            if n == len(typed):
                break
        return best

    @F.pandas_udf("start int, length int")
    def run(canon: pd.Series, typed: pd.Series) -> pd.DataFrame:
        found = [of(list(c), list(t)) if c is not None and t is not None else None for c, t in zip(canon, typed, strict=True)]
        return pd.DataFrame({"start": [f[0] if f else None for f in found], "length": [f[1] if f else None for f in found]}).astype("Int32")

    return run


def phrase_end(drift: str):
    """(canon, phrase) -> how many words of canon there are up to the end of the phrase's first occurrence, or null. One word is looked for as it is before it is in another spelling."""
    same = _same(drift)

    def of(canon: list[str], phrase: list[str]) -> int | None:
        if len(phrase) == 1 and phrase[0] in canon:
            return canon.index(phrase[0]) + 1
        starts = range(len(canon) - len(phrase) + 1) if phrase else ()
        return next((i + len(phrase) for i in starts if all(map(same, canon[i : i + len(phrase)], phrase))), None)

    @F.pandas_udf("int")
    def end(canon: pd.Series, phrase: pd.Series) -> pd.Series:
        return pd.Series([of(list(c), list(p)) if c is not None and p is not None else None for c, p in zip(canon, phrase, strict=True)], dtype="Int32")

    return end


def ordered_segments(drift: str):
    """(canon, segments) -> whether all segments align one after another."""
    same = _same(drift)

    @F.pandas_udf("boolean")
    def ordered(canon: pd.Series, segments: pd.Series) -> pd.Series:
        def fits(words, parts) -> bool:
            at = 0
            for part in parts:
                found = first_alignment(list(words), list(part), same, at)
                if found is None:
                    return False
                at = found[1]
            return True

        return pd.Series([h is not None and s is not None and fits(h, s) for h, s in zip(canon, segments, strict=True)], dtype=bool)

    return ordered


def window_distance(drift: str):
    """(cited, canon, budget) -> the smallest distance of cited to a run of canon, null above budget, or where any is null."""
    same = _same(drift)

    @F.pandas_udf("int")
    def distance(cited: pd.Series, canon: pd.Series, budget: pd.Series) -> pd.Series:
        out = []
        for c, h, b in zip(cited, canon, budget, strict=True):
            if c is None or h is None or pd.isna(b):
                out.append(None)
                continue
            b = int(b)
            best = min(distances(list(c), list(h), same, True, b)[-1]) if len(c) and len(c) <= len(h) + b else None
            out.append(best if best is not None and best <= b else None)
        return pd.Series(out, dtype="Int32")

    return distance


def best_window(drift: str):
    """(cited, canon, display) -> distance, first word and length of the closest run of canon, and the edits to its display words.

    Of runs of equal distance the one with most words kept wins, then the one closest in length, then the first.
    """
    same = _same(drift)

    def of(c: list[str], h: list[str], shown: list[str]) -> dict | None:
        if not c or not h:
            return None
        ends = distances(c, h, same, True)[-1]
        least = min(ends)
        best = None
        for end in [j for j, d in enumerate(ends) if d == least]:
            for start in range(max(0, end - len(c) - least), min(end, end - len(c) + least) + 1):
                window = h[start:end]
                if not window or distances(c, window, same, False)[-1][-1] != least:
                    continue
                edits = trace(c, window, same)
                rank = (-sum(e["op"] == "keep" for e in edits), abs(len(window) - len(c)), start)
                if best is None or rank < best[0]:
                    best = (rank, start, len(window), edits)
        if best is None:
            return None
        at = best[1]
        for edit in best[3]:
            if edit["authentic"] is not None:
                edit["authentic"] = shown[at] if at < len(shown) else edit["authentic"]
                at += 1
        return {"distance": least, "start": best[1], "length": best[2], "diff": best[3]}

    @F.pandas_udf("distance int, start int, length int, diff array<struct<op:string,cited:string,authentic:string>>")
    def window(cited: pd.Series, canon: pd.Series, display: pd.Series) -> pd.DataFrame:
        lists = ([list(x) if x is not None else None for x in column] for column in (cited, canon, display))
        found = [of(c or [], h or [], d if d is not None else h or []) or {} for c, h, d in zip(*lists, strict=True)]
        whole = {c: pd.array([f.get(c) for f in found], dtype="Int32") for c in ("distance", "start", "length")}
        return pd.DataFrame(whole | {"diff": pd.Series([f.get("diff") for f in found], dtype=object)})

    return window
