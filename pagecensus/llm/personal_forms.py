"""Written forms of personal data and of what resembles it, for fitting the field.

Forms are made from a seed: numbers, names and hosts are random, the ways of writing them and what
stands before them are listed here.
"""

from __future__ import annotations

import random

# Parameters of the operator: how kinds are written, what announces them, and what only looks alike.
# d is a digit, n a digit from 2 to 9; other characters stand for themselves.
PHONES = [
    "+1 (ndd) ddd-dddd", "(ndd) ddd-dddd", "(ndd)ddd-dddd", "ndd-ddd-dddd", "ndd.ddd.dddd", "1-ndd-ddd-dddd", "+1-ndd-ddd-dddd",
    "+49 ndd ddddddd", "+49 (0) ndd dddddd", "01nd ddddddd", "0ndd/dddddd", "0nd dd dd dd dd", "+33 n dd dd dd dd", "+34 ndd ddd ddd",
    "+44 nd dddd dddd", "0nd dddd dddd", "+44ndddddddddd", "+1nddddddddd", "ndd ddd dddd",
]
CARDS = ["dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd", "dddd dddddd ddddd", "ddddddddddddddd"]
IPS = ["{}.{}.{}.{}"]
MAILS = ["{a}.{b}@{h}.{t}", "{a}{n}@{h}.{t}", "{a}_{b}@mail.{h}.{t}", "{a}+{b}@{h}.co.{t}", "{a}-{b}.{n}@{h}{n}.example.{t}"]
SECRETS = ["hex40", "hex32", "sk_live_mix24", "AKIAup16", "ghp_mix36", "mix32", "mix44", "eyJmix40"]
CUES = {
    "phone": ["call", "tel", "tel.:", "phone:", "Telefon", "téléphone :", "teléfono", "fax", "mobile", "ring us at", ""],
    "card": ["card", "visa", "credit card:", "Karte", "tarjeta", "paid with", ""],
    "ip": ["from", "host", "ip", "address:", "server", "blocked", ""],
    "email": ["mail", "write to", "contact:", "e-mail", "correo", "", ""],
    "secret": ["token =", "api_key:", "secret =", "password:", "API key", "auth token", "bearer"],
}
OTHERS = [
    "20dd-01-nd", "nd.01.20dd", "1d/0n/20dd", "1d:nd:nd", "$n,ddd.dd", "n.dd.d", "n.d.d.d.d", "978-n-dddd-dddd-d", "order dddddddd", "no. dddddddddd",
    "page ddd", "n,ddd,ddd", "dd.dddd", "19dd-20dd", "ddd ddd", "x=ddd y=ddd", "id ddddddddddddddddddd", "§ ddd-dd", "nd%", "dd dd dd",
    "ddd.ddd.ddd.ddd", "v1.d.dd", "serial ddddddddddd", "dddddd-dddddd", "lot dddd dddd", "ISBN ndddddddddddd", "sum ddddddd",
]
NOT_MAILS = ["@{a}", "{a}@", "{a} @ {b}", "{a}@{b}", "{a}@localhost", "a@{n}", "#{a}@{b}"]
NOT_SECRETS = ["{a}-{b}-{a}-{b}-{a}", "{a}_{b}_{a}_{b}_list", "{a}{b}{a}{b}{a}{b}", "----------------------", "________________________", "0000000000000000000000"]
FILL = "the and of report for team we der die und von les des une los las con please see note then about after page data list".split()


def _number(pattern: str, draw: random.Random) -> str:
    return "".join(draw.choice("0123456789") if c == "d" else draw.choice("23456789") if c == "n" else c for c in pattern)


def _word(draw: random.Random) -> str:
    return "".join(draw.choice(["an", "er", "lo", "mi", "ta", "ker", "son", "be", "ru", "di"]) for _ in range(draw.randint(2, 4)))


def _card(pattern: str, draw: random.Random, valid: bool) -> str:
    """A number whose last digit makes its checksum right, or wrong."""
    text = draw.choice("3456") + _number(pattern[1:], draw)
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1]) if i)
    last = -total % 10
    return text[:-1] + str(last if valid else (last + draw.randint(1, 9)) % 10)


def _secret(pattern: str, draw: random.Random) -> str:
    for name, letters in (("hex", "0123456789abcdef"), ("up", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), ("mix", "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789")):
        head, found, size = pattern.partition(name)
        if found and size.isdigit():
            return head + "".join(draw.choice(letters) for _ in range(int(size)))
    return pattern


def _filled(pattern: str, draw: random.Random) -> str:
    return pattern.format(a=_word(draw), b=_word(draw), h=_word(draw), t=draw.choice(["com", "org", "net", "de", "fr", "es"]), n=draw.randint(1, 99))


def written(kinds: tuple[str, ...], count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of ``count`` sentences with one form each; spans are (kind, start, end), none for
    forms that are no personal data."""
    draw = random.Random(seed)
    out = []
    for n in range(count):
        kind = draw.choice([*kinds, "other", "other"])
        if kind == "phone":
            form = _number(draw.choice(PHONES), draw)
        elif kind == "card":
            form = _card(draw.choice(CARDS), draw, True)
        elif kind == "ip":
            form = draw.choice(IPS).format(*(draw.randint(0, 255) for _ in range(4)))
        elif kind == "email":
            form = _filled(draw.choice(MAILS), draw)
        elif kind == "secret":
            form = _secret(draw.choice(SECRETS), draw)
        else:
            form = draw.choice([
                lambda: _number(draw.choice(OTHERS), draw), lambda: _card(draw.choice(CARDS), draw, False),
                lambda: "{}.{}.{}.{}".format(*(draw.randint(0, 255) for _ in range(3)), draw.randint(256, 999)),
                lambda: _filled(draw.choice(NOT_MAILS), draw), lambda: _filled(draw.choice(NOT_SECRETS), draw),
            ])()
        cue = draw.choice(CUES[kind]) if kind in CUES else draw.choice(["", "", "call", "from", "card", "key"])
        left = " ".join(draw.choice(FILL) for _ in range(draw.randint(0, 4)))
        left = " ".join(x for x in (left, cue) if x)
        left += draw.choice([" ", " ", ": ", " ("]) if left else ""
        text = left + form + draw.choice(["", ".", ",", " ", ")"]) + " " + " ".join(draw.choice(FILL) for _ in range(draw.randint(0, 4)))
        out.append((text, [(kinds.index(kind), len(left), len(left) + len(form))] if kind in kinds else []))
    return out
