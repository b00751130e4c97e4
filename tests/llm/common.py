"""Brute-force twins and small fixtures of the numbered operators."""

import hashlib
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, token string, part long, at string, n string, fill string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    base = " ".join(f"w{i % 37}x{i % 11}" for i in range(60))
    line = "This Line Is Long Enough To Be Counted As Repeated, é"
    texts = {
        1: base, 2: base, 3: base + " tail", 4: None, 5: "", 6: "   \n\t ", 7: "a b", 8: "A B", 9: f"{line}\nfirst {base[:80]}\n  {line.lower()}  ", 10: line, 11: f"x\n{line}", 12: f"{line}\n{line}",
        13: f"\t{line}\ny", 14: "|" + " |" * 90, 15: "ab " * 4000, 16: "é" * 50 + " 😀 naïve  double  spaces \n next", 17: base.upper(), 18: "word nbsp", 19: "\x00nul \x1c sep", 20: "end ",
    }
    rows = [(i, x, "en", "s", len(x or ""), "c", "t", 1, "a", "n", "f") for i, x in texts.items()]
    rows += [rows[0], rows[9], (None, base, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def lines_brute(docs, least=5, chars=40):
    """(doc_id, text) rows, a row a document -> sorted results."""
    seen, last = {}, {}
    strip = " \t\n\v\f\r"
    for i, text in docs:
        for k in {low(x.strip(strip)) for x in (text or "").split("\n")}:
            if len(k) >= chars:
                seen[k] = seen.get(k, 0) + 1
                if i is not None:
                    last[k] = max(last.get(k, i), i)
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or seen.get(k := low(x.strip(strip)), 0) < least or last.get(k) == i]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def spans_brute(docs, width=20):
    first = {}
    by_id = {i: WORD.findall(text or "") for i, text in docs if i is not None}
    removed = {}
    for i in sorted(by_id):
        w, gone = by_id[i], set()
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            if k in first:
                gone.update(range(a, a + width))
            else:
                first[k] = (i, a)
        removed[i] = gone
    out = []
    for i, text in docs:
        w, gone = WORD.findall(text or ""), removed.get(i, set())
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def shingles(text, k=5):
    w = WORD.findall(low(text or ""))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups_brute(docs, percent=75):
    sets = {i: shingles(text) for i, text in docs if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                shared = len(sets[x] & sets[y])
                if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    return [(i, len(shingles(text)), None if i is None else root(i)) for i, text in docs]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
