"""Made-up contexts that teach the field what no pattern labels: national and re-spelt forms, and numbers that are none."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Forms with a label: D is a digit, N one from 2 to 9, C a card's digits, I an address, L an email's local part, H its domain.
PHONES = ("0DD DDDD DDDD", "(NDD) NDD-DDDD", "00DD DD DDDD DDDD", "NDD-NDD-DDDD", "0NDD/DDDDDDD", "0NDD DDDDDDD", "NDD.NDD.DDDD", "0DD-DDDD DDDD", "00DD NDDD DDDDDDD", "(0DD) DDD DDDD", "0NDD DDD DDDD", "1-NDD-NDD-DDDD")
EMAILS = ("L(at)H", "L [at] H", "L{at}H", "L [at] F", "L(at)G", "L at F")
CARDS = (".", "_", "/", "  ", " / ")
ADDRESSES = ("[.]", " . ", "(.)", "[dot]")
#: Numbers that are nobody's: sums, dates, versions, book and part numbers, coordinates, ranges, lists.
OTHERS = (
    "N,DDD,DDD.DD", "ND,DDD,DDD,DDD", "N,DDD,DDD,DDD", "NDD,DDD,DDD", "N.DDD.DDD,DD", "NDD.DDD.DDD.DDD", "20DD-0N-1D", "1D.0N.20DD", "20DD-0N-1D 1D:2D:3D", "1D/0N/19DD", "1D.0N.20DD 1D:3D", "vN.DD.DDD", "N.DD.D-rcN",
    "N.D.DDDD.DDDD", "978-N-DDDD-DDDD-D", "978 N DD DDDDDD D", "DDDDDDDDDD", "DDDDDDDD", "DDDD-DDDDDD", "ND.DDDDDD, ND.DDDDDD", "19DD-20DD, 19DD", "1DDD-1DDD", "N.DDDDDDDDDDDDD", "DD DD DD DD DD DD", "NDD x NDD x NDD", "N,DDD; N,DDD; N,DDD",
    "DDDDDDDDDDDDDD", "20DD0N1DDDDDDD", "N DDD DDD DDD", "N'DDD'DDD.DD", "DDDD DDDD DDDD", "20DD/DDDD/DDDD", "DD-DDDDDDD", "DDDDD DDDDD",
)
LOCALS = ("jane", "jane.doe", "j_doe", "info", "max-m", "a.b.c", "mary.ann.lee", "office", "k.o", "sales24", "x.y-z")
HOSTS = ("example.com", "mail.example.org", "host.co.uk", "uni-town.edu", "site.net", "example.de")
CALLS = ("call", "phone", "tel", "fax", "mobile", "ring", "reach", "Tel.", "Phone:", "number is", "on", "at", "under", "contact", "dial")
WRITES = ("write to", "mail", "email", "contact", "to", "from", "address", "ask")
PAYS = ("card", "pay with", "charged", "visa", "account")
HOSTED = ("server", "host", "from", "at", "address")
SAYS = ("cost", "total", "population", "on", "version", "isbn", "order", "pages", "id", "about", "sum of", "of", "number", "in", "part", "ref", "at", "between", "measured", "invoice", "no", "ticket", "the", "for")
AFTER = ("today", "please", "now", "and more", "dollars", "people", "in all", "later", ".", "", "!", "or so", "units")


def _digits(rng: random.Random, form: str) -> str:
    return "".join(str(rng.randrange(10)) if c == "D" else str(rng.randrange(2, 10)) if c == "N" else c for c in form)


def card(rng: random.Random) -> str:
    """Sixteen digits whose check digit is right."""
    body = [rng.randrange(10) for _ in range(15)]
    doubled = sum(d * 2 - 9 * (d > 4) if k % 2 == 0 else d for k, d in enumerate(body))
    return "".join(map(str, body)) + str(-doubled % 10)


def lessons(n: int = 700, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(context, spans)."""
    rng = random.Random(seed)
    for k in range(n):
        kind = ("phone", "", "email", "", "phone", "", "card", "ip", "", "email")[k % 10]
        if kind == "phone":
            said, before = _digits(rng, rng.choice(PHONES)), rng.choice(CALLS)
        elif kind == "email":
            local, host = rng.choice(LOCALS), rng.choice(HOSTS)
            spelt = {"F": host.replace(".", " dot "), "G": host.replace(".", "(dot)"), "H": host, "L": local}
            said, before = "".join(spelt.get(c, c) for c in rng.choice(EMAILS)), rng.choice(WRITES)
        elif kind == "card":
            digits, mark = card(rng), rng.choice(CARDS)
            said, before = mark.join(digits if mark == "_" else [digits[i : i + 4] for i in range(0, 16, 4)]), rng.choice(PAYS)
        elif kind == "ip":
            said, before = rng.choice(ADDRESSES).join(str(rng.randrange(256)) for _ in range(4)), rng.choice(HOSTED)
        else:
            said, before = _digits(rng, rng.choice(OTHERS)), rng.choice(SAYS)
        start = len(before) + 1
        yield f"{before} {said} {rng.choice(AFTER)}".rstrip(), [(start, start + len(said), kind)] if kind else []
