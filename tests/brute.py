"""Plain Python answers for small fixtures, written from the documented rules."""

import re

CJK = re.compile(r"[一-鿿㐀-䶿]")


def toks(text):
    low = text.lower()
    han = CJK.findall(low)
    found = re.findall(r"[a-z0-9]+", low) + han + [a + b for a, b in zip(han, han[1:])]
    return list(dict.fromkeys(found))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def index_of(rows, with_folders):
    """token -> positions, in first-seen order."""
    table = {}
    for i, (repo, file, ext, folder, size, txt) in enumerate(rows):
        for t in toks(" ".join([file, *folder]) if with_folders else file):
            table.setdefault(t, []).append(i)
    return table


def vocab_of(table):
    seen = {t: i for i, t in enumerate(table)}

    def key(t):
        whole = re.fullmatch(r"0|[1-9]\d*", t) and int(t) < 2**32 - 1
        return (-len(table[t]), 0 if whole else 1, int(t) if whole else 0, seen[t])

    return sorted(table, key=key)


def candidates(token, table, vocab):
    if token in table:
        return {i: 0 for i in table[token]}, [token]
    got, used, n = {}, [], 0
    for term in vocab:
        if n >= 200:
            break
        if distance(token, term) <= 2:
            used.append(term)
            n += len(table[term])
            for i in table[term]:
                got.setdefault(i, len(used) - 1)
    return got, used


def keep(row, p):
    repo, file, ext, folder, size, txt = row
    path = "/".join(folder)
    clean = lambda f: f.strip("/")
    if p.get("repos") and repo not in p["repos"]:
        return False
    if p.get("extensions") and ext.lower() not in p["extensions"]:
        return False
    if p.get("folder_match_mode") == "mixed":
        own = {clean(f) for f in p.get("folder_selfs") or []} - {""}
        below = {clean(f) for f in p.get("folder_subtrees") or []} - {""}
        ups = {"/".join(folder[:d]) for d in range(1, len(folder) + 1)}
        if (own or below) and path not in own and not ups & below:
            return False
    elif p.get("folders"):
        wanted = [clean(f) for f in p["folders"]]
        if p.get("folder_match_mode") == "exact":
            ok = path in wanted
        else:
            ok = any(path == f or (f and path.startswith(f + "/")) for f in wanted)
        if not ok:
            return False
    if size and size > 0:
        if p.get("min_size") is not None and size < p["min_size"]:
            return False
        if p.get("max_size") is not None and size > p["max_size"]:
            return False
    return True


def search(rows, **p):
    """(total, [(position in rows, score)] of the asked page)."""
    q = (p.get("q") or "").strip()
    deep = p.get("search_folders", True) is not False
    words = toks(q)
    fields = [(f.lower(), r.lower(), "/".join(d).lower() if deep else "") for r, f, _, d, _, _ in rows]
    if not q:
        hits = {i: 0 for i in range(len(rows))}
    elif p.get("exact") or re.search(r"[^a-zA-Z0-9一-鿿㐀-䶿\s]", q):
        if "*" in q or "?" in q:
            parts = {"*": ".*", "?": "."}
            test = re.compile("".join(parts.get(c, re.escape(c)) for c in q), re.I).search
        else:
            test = lambda s: q.lower() in s
        hits = {i: 0 for i, (f, r, d) in enumerate(fields) if test(f) or test(r) or (deep and test(d))}
    else:
        table = index_of(rows, deep)
        vocab = vocab_of(table)
        per_word = [candidates(w, table, vocab)[0] for w in words]
        hits = {i: tie for i, tie in per_word[0].items() if all(i in c for c in per_word)}
    scored = []
    for i, tie in hits.items():
        if keep(rows[i], p):
            f, r, d = fields[i]
            scored.append((i, tie, sum(3 * (w in f) + 2 * (deep and w in d) + (w in r) for w in words)))
    sort = p.get("sort")
    if sort == "name":
        scored.sort(key=lambda h: (rows[h[0]][1], h[1], h[0]))
    elif sort == "size":
        scored.sort(key=lambda h: (-(rows[h[0]][4] or 0), h[1], h[0]))
    else:
        scored.sort(key=lambda h: (-h[2], h[1], h[0]))
    page = max(1, p.get("page") or 1)
    size = max(1, min(500, p.get("page_size") or 100))
    chosen = scored[(page - 1) * size: page * size]
    return len(scored), [(i, s) for i, _, s in chosen]
