"""Golden-case notation of FIXTURES.md: one letter is one line."""

MARKS = {"H": "<<<<<<< L\n", "M": "=======\n", "E": ">>>>>>> R\n", "B": "||||||| B\n"}


def text(spec: str, final_newline: bool = True) -> str:
    out = []
    for tok in spec.split():
        out.append(MARKS.get(tok, tok + "\n"))
    s = "".join(out)
    if not final_newline and s.endswith("\n"):
        s = s[:-1]
    return s
