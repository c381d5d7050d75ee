"""The labelled table of the personal-data field: lines of words, each word with its tag.

The lines are made up from a fixed seed: invented words of several languages
and styles, personal data in their usual formats, also in groups, in quotes,
behind a label or glued by commas, and look-alikes (dates, prices, versions,
times, order numbers, rows of numbers, hexadecimal strings) that are none.
"""

from __future__ import annotations

import random
import re
import string

TAGS = ["O", "EMAIL", "IP", "CARD", "CARD_I", "SSN", "IBAN", "IBAN_I", "PHONE", "PHONE_I"]

#: What parts words besides white space.
SEPARATORS = ',;<>"|=[]{}'

_SYLLABLES = "the re tion on er an es ou in ver ge ich keit lich é è re la ción mente as os que ñ í de st nd pfe ß ü".split()
_JUNK = ["", "", "", "", "", ".", ",", "!", "?", ";", ":", "!!", "###", "%%%", "$$$", "&&&", "***"]


def split_words(line: str) -> list[str]:
    """The words of a line: parted by white space, by SEPARATORS, and by a colon behind a run of letters and digits that is no hexadecimal number."""
    parted = re.sub(r"([^\W_]*[^\W\d_a-fA-F][^\W_]*):", r"\1 ", re.sub(f"[{re.escape(SEPARATORS)}]", " ", line))
    return parted.split()


def _word(rng: random.Random) -> str:
    w = "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    return rng.choice([w, w, w, w, w.capitalize(), w.upper()])


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices(string.digits, k=n))


def _email(rng: random.Random) -> list[str]:
    name = rng.choice([lambda: _word(rng) + "." + _digits(rng, 2), lambda: _word(rng), lambda: _word(rng) + rng.choice("._-") + _word(rng), lambda: _word(rng) + _digits(rng, rng.randint(1, 4)), lambda: _word(rng) + "+" + _word(rng)])()
    host = rng.choice([lambda: _word(rng), lambda: "mail" + _digits(rng, 1), lambda: _word(rng) + "-" + _word(rng)])()
    end = rng.choice([".example.com", ".com", ".org", ".co.uk", ".de", "." + _word(rng) + ".net"])
    whole = name + "@" + host + end
    return [rng.choice([whole, whole.lower(), whole.lower(), whole.upper(), whole.capitalize()])]


def _phone(rng: random.Random) -> list[str]:
    d = lambda n: _digits(rng, n)
    return rng.choice(
        [
            lambda: [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"],
            lambda: [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"],
            lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"],
            lambda: [f"+{d(2)}", d(3), d(7)],
            lambda: [f"+{d(2)}", d(rng.choice([2, 3])), d(rng.choice([3, 4])), d(4)],
            lambda: [f"+{d(rng.choice([1, 2, 3]))}", d(rng.choice([1, 2, 3])), d(3), d(rng.choice([2, 3, 4])), d(2)],
            lambda: [f"{d(3)}-{d(3)}-{d(4)}"],
            lambda: [f"{d(3)}.{d(3)}.{d(4)}"],
            lambda: [d(3), d(3), d(4)],
            lambda: [f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"],
            lambda: [f"({d(3)}){d(3)}-{d(4)}"],
            lambda: [f"+{d(rng.randint(10, 12))}"],
        ]
    )()


def _groups(text: str, size: int = 4) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _iban(rng: random.Random) -> list[str]:
    head = "".join(rng.choices(string.ascii_uppercase, k=2)) + _digits(rng, 2)
    body = rng.choice([lambda: _digits(rng, rng.choice([14, 16, 18, 20])), lambda: _digits(rng, rng.choice([18, 20])), lambda: "".join(rng.choices(string.ascii_uppercase, k=4)) + _digits(rng, rng.choice([14, 16, 18])), lambda: _digits(rng, 10) + "".join(rng.choices(string.ascii_uppercase + string.digits, k=11)) + _digits(rng, 2)])()
    whole = head + body
    return rng.choice([lambda: [whole], lambda: [whole], lambda: _groups(whole)])()


def _ip(rng: random.Random) -> list[str]:
    four = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    group = lambda: f"{rng.randint(0, 0xFFFF):x}"
    six = rng.choice([lambda: ":".join(group() for _ in range(8)), lambda: f"2001:db8::{group()}", lambda: f"fe80::{group()}:{group()}:{group()}:{group()}", lambda: f"{group()}:{group()}::{group()}:{group()}"])()
    return [rng.choice([four, four, four, four, four, f"{four}:{_digits(rng, rng.choice([2, 4, 5]))}", six, six, six.upper()])]


def _data(rng: random.Random) -> tuple[str, list[str]]:
    kind = rng.choice(["EMAIL", "EMAIL", "IP", "IP", "CARD", "CARD", "PHONE", "PHONE", "PHONE", "SSN", "IBAN", "IBAN"])
    if kind == "EMAIL":
        return kind, _email(rng)
    if kind == "IP":
        return kind, _ip(rng)
    if kind == "CARD":
        number = _digits(rng, 16)
        return kind, rng.choice([lambda: [number], lambda: [number], lambda: ["-".join(_groups(number))], lambda: _groups(number), lambda: [number[:4], number[4:10], number[10:15]], lambda: ["-".join([number[:4], number[4:10], number[10:15]])], lambda: [number[:15]]])()
    if kind == "PHONE":
        return kind, _phone(rng)
    if kind == "SSN":
        return kind, [f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}"]
    return kind, _iban(rng)


def _lookalike(rng: random.Random) -> list[str]:
    d = lambda n: _digits(rng, n)
    return rng.choice(
        [
            lambda: [d(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20]))],
            lambda: [d(rng.choice([1, 2, 3, 4, 5, 6])) for _ in range(2)],
            lambda: [d(rng.choice([1, 2])), d(3), d(3)],
            lambda: [d(rng.choice([1, 2])) for _ in range(rng.randint(3, 6))],
            lambda: [f"{d(4)}-{d(2)}-{d(2)}"],
            lambda: [f"{d(2)}.{d(2)}.{d(4)}"],
            lambda: [f"{d(2)}:{d(2)}"],
            lambda: [f"{d(2)}:{d(2)}:{d(2)}"],
            lambda: [f"{d(1)}.{d(1)}"],
            lambda: [f"{d(1)}.{d(1)}.{d(2)}"],
            lambda: [f"{d(2)},{d(3)}"],
            lambda: [f"{d(2)}%"],
            lambda: [f"{_word(rng)}-{d(2)}"],
            lambda: [f"{d(3)}-{d(3)}"],
            lambda: [f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"],
            lambda: ["token", "=", '"' + "".join(rng.choices("0123456789abcdef", k=40)) + '"'],
            lambda: ["TOKEN", "=", '"' + "".join(rng.choices("0123456789ABCDEF", k=40)) + '"'],
            lambda: ["".join(rng.choices(string.ascii_uppercase, k=2)) + d(rng.choice([2, 4]))],
            lambda: [":".join(f"{rng.randint(0, 255):02x}" for _ in range(6))],
            lambda: ["|"],
            lambda: [f"({_word(rng)})"],
            lambda: [f"({d(1)})"],
            lambda: [f"@{_word(rng)}"],
            lambda: [f"{_word(rng)}.{_word(rng)}"],
            lambda: [f"https://{_word(rng)}.example.com/{d(3)}"],
            lambda: ["CC", "BY-NC", "4.0"],
        ]
    )()


def labelled_lines(n: int, seed: int = 20240607) -> list[tuple[str, list[str]]]:
    """n lines, each with a tag for each of its words."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        line, tags = "", []
        style = rng.choice(_JUNK) if rng.random() < 0.3 else None
        for _ in range(rng.randint(1, 12)):
            pick = rng.random()
            kind = "O"
            if pick < 0.70:
                parts = [_word(rng)]
            elif pick < 0.82:
                parts = _lookalike(rng)
            else:
                kind, parts = _data(rng)
            # punctuation after the last word of each part, as in running text
            end = style if style is not None else rng.choice(_JUNK[:9])
            before, after = "", end
            if kind != "O":
                before, after = rng.choice([("", end)] * 8 + [('"', '"' + end), ("<", ">" + end), (rng.choice(["mailto:", "Tel:", "ip:", "IBAN:", "no="]), end), (_word(rng) + ",", "," + _word(rng))])
            text = " ".join(parts)
            ahead, own = len(split_words(before)), len(split_words(text))
            whole = before + text + after
            line += " " * bool(line) + whole
            more = kind if kind == "O" else kind + "_I"
            tags += ["O"] * ahead + [kind] * min(own, 1) + [more] * (own - 1) + ["O"] * (len(split_words(whole)) - ahead - own)
        out.append((line, tags))
    return out
