"""A plain restatement of clause location and line boxes, for tests."""

import re

from parchment.functions import rules

TOKEN = re.compile("[a-z0-9]+")


def locate(words, clauses):
    """Word numbers of each clause that can be located, in document order."""
    tokens, owner = [], []
    for i, w in enumerate(words):
        for t in TOKEN.findall(w.lower()):
            tokens.append(t)
            owner.append(i)
    cursor, found = 0, {}
    for clause_id, body in clauses:
        wanted = TOKEN.findall(body.lower())
        for k in sorted({min(k, len(wanted)) for k in (1, 2, 4)} - {0}, reverse=True):
            for low, high in ((cursor, min(len(tokens), cursor + rules.SEARCH_WINDOW)), (0, len(tokens))):
                start = next((j for j in range(low, high - k + 1) if tokens[j : j + k] == wanted[:k]), None)
                hits, j = [], start
                for t in wanted if start is not None else ():
                    window = tokens[j : j + rules.MAX_SKIP + 1]
                    if t in window:
                        j += window.index(t) + 1
                        hits.append(j - 1)
                if hits and len(hits) >= rules.MIN_COVERAGE * len(wanted):
                    break
            else:
                continue
            found[clause_id] = sorted({owner[j] for j in hits})
            cursor = hits[-1] + 1
            break
    return found


def line_boxes(boxes):
    out = []
    for page, x0, top, x1, bottom in boxes:
        if out and out[-1][0] == page and abs(out[-1][2] - top) <= rules.SAME_LINE:
            b = out[-1]
            out[-1] = [page, min(b[1], x0), min(b[2], top), max(b[3], x1), max(b[4], bottom)]
        else:
            out.append([page, x0, top, x1, bottom])
    return out
