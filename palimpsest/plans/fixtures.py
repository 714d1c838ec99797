"""Small tables written here by a rule, for the queries whose inputs the driver's tables don't hold. All values are invented."""

from __future__ import annotations

import re

import json

FILLER = "Invoice for the works at the quay, sent by post and paid in parts. "


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, cols: list[str], rows: list[tuple]) -> str:
    """A common table expression with these rows."""
    return f"{name}({', '.join(cols)}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _text(n: int, core: str) -> str:
    return (core + " " + FILLER * 12)[:n]


def _sample(n: int, core: str, pii: list[tuple[str, str]]) -> str:
    return json.dumps({"ocr_text": _text(n, core), "pii": [{"type": t, "value": v} for t, v in pii]})


ANN = ("full_name", "Ann Example")
MAIL = ("email_address", "ann@example.com")
CORE = "Ann Example ann@example.com 192.0.2.7"

#: (line_no, raw)
SAMPLE_LINES = [
    (1, _sample(350, CORE, [ANN, MAIL])),
    (2, ""),
    (3, "   "),
    (4, "{not json"),
    (5, _sample(350, CORE, [("nickname", "Ann")])),
    (6, _sample(350, CORE, [("full_name", "")])),
    (7, _sample(299, CORE, [ANN])),
    (8, _sample(300, CORE, [ANN])),
    (9, _sample(500, CORE, [ANN])),
    (10, _sample(501, CORE, [ANN])),
    (11, _sample(400, "..." + " " * 160 + CORE, [ANN])),
    (12, _sample(350, CORE, [("full_name", "Bob Example")])),
    (13, _sample(350, CORE, [("full_name", "Example Ann"), ("phone_number", "555-0100"), ("other_pii", "Zed Zed")])),
    (14, _sample(350, "nobody", [])),
]

#: (sample_id, seq, type, value) before and after an audit
AUDIT_OLD = [(1, 0, *ANN), (1, 1, *MAIL), (2, 0, *ANN), (3, 0, "full_name", "Bob Example"), (4, 0, *MAIL)]
AUDIT_NEW = [(1, 0, *ANN), (1, 1, *MAIL), (2, 0, *ANN), (2, 1, "other_pii", "Gate 7"), (3, 0, "other_pii", "Bob Example"), (4, 0, *MAIL)]

#: (label, text, start, score) of two detectors
LEFT = [("name", "Ann Example", 0, 0.91), ("email", "ann@example.com", 12, 0.88), ("name", "Ann Example", 40, 0.75), ("city", "Quay", 60, 0.4)]
RIGHT = [("name", "Ann Example", 0, 0.91), ("name", "Ann Example", 40, 0.7), ("email", "ann@example.com", 12, 0.88), ("state", "WA", 70, 0.5)]

#: (row_id, text, spans): spans are list literals as Python writes them
SPAN_ROWS = [
    (1, "Ann Example, P.O. Box 12, Quay", str([{"start": 0, "end": 11, "text": "Ann Example", "label": "name"}, {"start": 13, "end": 24, "text": "P.O. Box 12", "label": "po_box"}])),
    (2, "post office box 9 and more " + "x" * 90 + " Ann", str([{"start": 0, "end": 17, "text": "post office box 9", "label": "po_box"}, {"start": 118, "end": 121, "text": "Ann", "label": "name"}])),
    (3, "nothing here", "[broken"),
    (4, "no box, but Bob", str([{"start": 12, "end": 15, "text": "Bob", "label": "name"}])),
    (5, "PO Box 7", str([{"start": None, "end": None, "text": "7", "label": "digits"}, {"start": 0, "end": 8, "text": "PO Box 7", "label": "po_box"}])),
]

#: (seq, value, type, line): custom values as pairs or as lines
CUSTOM = [
    (1, "Th Heing", "name", None),
    (2, None, None, "email=ann@example.com, 555-0100"),
    (3, None, None, "ssn=078-05-1120\nplain"),
    (4, "plain", "dob", None),
    (5, "  ", "name", None),
    (6, None, None, "weird=odd one,,=no type"),
    (7, "plain", "address", None),
    (8, "the of", "other", None),
    (9, "a=b", "Email", None),
]

#: (path)
FILES = [("/in/a.pdf",), ("/in/B.PDF",), ("/in/c.txt",), ("/in.d/e",), ("/in/f.tar.pdf",)]

#: (filename) found, and applied
MIGRATIONS = [("003_c.sql",), ("001_a.sql",), ("002_b.sql",), ("readme.md",), ("010_z.sql",)]
APPLIED = [("001_a.sql",), ("003_c.sql",)]

#: (type, raw) of identifier inputs
IDENTIFIER_INPUTS = [("ssn", "078051120"), ("ssn", "07805"), ("ssn", "078"), ("ssn", "07-80x"), ("ssn", "0780511209999"), ("dob", "0102"), ("dob", "01022003"), ("dob", "1"), ("email", "ann@example.com"), ("email", "ann@example"), ("name", " Ann "), ("other", ""), ("dob", "010220031"), ("address", "  ")]

#: (row_id, lines): request lines of the serve protocol
REQUEST_LINES = [
    (1, '{"cmd": "detect", "path": "/in/a.pdf", "options": {"chunk_size": 500}}'),
    (2, "  "),
    (3, "{oops"),
    (4, '{"cmd": "fly"}'),
    (5, '{"cmd": "scrub", "selected": ["Ann"], "color": "#112233"}'),
    (6, "log line, not an event"),
    (7, '{"cmd": "close"}'),
]

#: (status, message)
REDEEM = [(200, None), (400, "no_account here"), (400, "bad"), (403, "key_belongs_to_other_account"), (403, ""), (409, "already_applied"), (409, "x"), (429, None), (503, None), (500, "boom")]

#: (product_id, tier, pages, price_cents)
PRODUCTS = [("prod-s", "starter", 100, 900), ("prod-p", "pro", 500, 1900), ("prod-m", "max", 2000, 4900)]

ACCOUNT = "00000000-0000-4000-8000-00000000000%d"


def _order(kind: str, order: str, account: str | None, product: str | None, cents: int | None = 900, snake: bool = False) -> str:
    data = {"id": order, "metadata": {"account_id": account} if account else {}}
    data |= {"product_id" if snake else "productId": product, "total_amount" if snake else "totalAmount": cents}
    return json.dumps({"type": kind, "data": data})


#: (seq, body): purchase webhooks
ORDER_EVENTS = [
    (1, _order("order.paid", "o1", ACCOUNT % 1, "prod-s")),
    (2, _order("order.paid", "o1", ACCOUNT % 1, "prod-m")),
    (3, _order("order.created", "o2", ACCOUNT % 1, "prod-s")),
    (4, _order("order.paid", "o3", "not-a-uuid", "prod-s")),
    (5, _order("order.paid", "o4", ACCOUNT % 2, "prod-x")),
    (6, _order("order.paid", "o5", ACCOUNT % 2, "prod-p", 2100, True)),
    (7, _order("order.paid", "o6", None, "prod-s")),
    (8, _order("order.paid", "o7", ACCOUNT % 1, "prod-m", None)),
    (9, _order("order.paid", "", ACCOUNT % 1, "prod-m")),
]
BALANCES = [(ACCOUNT % 1, 100), (ACCOUNT % 3, 500)]
DONE_ORDERS = [("o7",)]

#: (done, total), (cents), (tier), (type)
PROGRESS = [(0, 0), (1, 3), (2, 3), (1, 8), (3, 8), (5, 1000), (7, 7)]
PRICES = [(900,), (1900,), (4950,), (1,), (0,)]
TIERS = [(None,), ("",), ("starter",), ("max",)]
TYPES = [("date_of_birth",), ("name",), ("ip_address",), ("nAME_x",)]
COLORS = [("#DC2626",), ("#dc262",), (None,), ("red",), ("#00ff00",)]

#: (client, seq, now, pages, expires_at, ceiling, used): offline requests
OFFLINE = [
    ("a", 1, "2024-01-01 10:00:00", 4, "2024-01-02 00:00:00", 10, 0),
    ("a", 2, "2024-01-01 11:00:00", 7, "2024-01-02 00:00:00", 10, 0),
    ("a", 3, "2024-01-01 12:00:00", 6, "2024-01-02 00:00:00", 10, 0),
    ("a", 4, "2024-01-02 00:00:00", 1, "2024-01-02 00:00:00", 10, 0),
    ("b", 1, "2024-01-01 10:00:00", 1, "2024-01-02 00:00:00", 10, 10),
    ("c", 1, "2024-01-01 10:00:00", 1, None, None, 0),
]


def load_capitals():
    """A stand-in model: words of three capitals or more, scored by their length; the shortest score too low, and one kind has no place."""
    word = re.compile(r"[A-Z]{3,}")

    def find(texts: list[str]) -> list[list[dict]]:
        return [[{"start": None if len(m.group()) == 5 else m.start(), "end": m.end(), "label": " Full_Name ", "text": m.group(), "score": min(1.0, len(m.group()) / 16)} for m in word.finditer(t)] for t in texts]

    return find


def load_reader():
    """A stand-in renderer and recogniser: 40 lines a page, words in cells of 50 by 40 pixels, every fifth line hardly legible."""

    def read(content: bytes, scale: float):
        lines = content.decode("utf-8").split("\n")
        for at in range(0, len(lines), 40):
            found = []
            for n, line in enumerate(lines[at : at + 40]):
                words = line.split(" ")
                polygons = [[{"x": i * 50.0 + dx, "y": n * 40.0 + dy} for dx, dy in ((0, 0), (45, 2), (45, 30), (1, 29))] for i in range(len(words))]
                found.append({"words": words, "polygons": polygons, "score": "0.29" if n % 5 == 0 else "0.9"})
            yield {"page_num": at // 40 + 1, "width": round(612 * scale), "height": 792 * scale, "lines": found}

    return read
