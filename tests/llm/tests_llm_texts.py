"""A small corpus for the pipeline's tests."""

import random


def prose(n, seed):
    r = random.Random(f"p{seed}")
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


PASSAGE = prose(60, "passage")
LONG = prose(9000, "long")
_base = prose(300, 1)
_texts = {
    1: _base, 2: _base, 3: _base.replace(_base.split()[200], "changed", 1), 4: "too short", 5: "the same words again and again\n" * 30, 6: None,
    10: prose(80, 10) + "\n" + PASSAGE + "\n" + prose(80, 11), 11: prose(70, 12) + "\n" + PASSAGE + "\n" + prose(90, 13), 20: prose(120, 20), 40: LONG, 30: prose(60, 30) + " jo.doe@mail.example.com " + prose(30, 31),
}
_rows = [*_texts.items(), (20, _texts[20]), (None, prose(100, "no id")), (None, None), (7, "")]
TABLE = [(i, t, "en", "s", None if t is None else len(t)) for i, t in _rows]
