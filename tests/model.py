"""A small, independent Python model of the conflict-text semantics, used by
the property tests (plain lists, written from the specification)."""

OPEN, SEP, CLOSE, BASE = "<<<<<<<", "=======", ">>>>>>>", "|||||||"


def blocks(lines):
    out, i, n = [], 0, len(lines)
    while i < n:
        if not lines[i].startswith(OPEN):
            i += 1
            continue
        sep = next((j for j in range(i + 1, n) if lines[j].startswith(SEP)), None)
        end = None if sep is None else next((j for j in range(sep + 1, n) if lines[j].startswith(CLOSE)), None)
        if end is None:
            break
        out.append((i, end))
        i = end + 1
    return out


def is_marker(x):
    return x.startswith(OPEN) or x.startswith(SEP) or x.startswith(CLOSE)


def contexts(lines, s, e, k=20):
    b = []
    j = s - 1
    while j >= 0 and len(b) < k and not is_marker(lines[j]):
        b.insert(0, lines[j])
        j -= 1
    a = []
    j = e + 1
    while j < len(lines) and len(a) < k and not is_marker(lines[j]):
        a.append(lines[j])
        j += 1
    return b, a


def matches(hay, pat):
    if not pat:
        return list(range(len(hay)))
    m = len(pat)
    return [i for i in range(len(hay) - m + 1) if hay[i:i + m] == pat]


def resolve(merged, lines, s, e):
    b, a = contexts(lines, s, e)
    B, A = matches(merged, b), matches(merged, a)
    if not B:
        return "before_not_found", None
    if not A:
        return "after_not_found", None
    if len(B) > 1 and len(A) > 1:
        return "ambiguous", None
    if len(B) == 1:
        i1 = B[0]
        ok = [x for x in A if x >= i1 + len(b)]
        if not ok:
            return "no_valid_after", None
        i2 = min(ok)
    else:
        i2 = A[0]
        ok = [x for x in B if x + len(b) <= i2]
        if not ok:
            return "no_valid_before", None
        i1 = max(ok)
    return "ok", merged[i1 + len(b):i2]
