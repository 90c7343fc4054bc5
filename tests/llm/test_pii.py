import random
import re

from gleanframe.llm import pii
from tests.llm.helpers import docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[2])))


def test_base_patterns_match_plain_search():
    rng = random.Random(4)
    parts = ["a@b.c", "_x@d.e", "@", ".", "-", " ", "+", "1", "25", "300", "1.2.3.4", "4432507379035540", "+1 (743) 555-3824", "é", "x@", "\n", "0000255", ")", "4 4 3 2"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 300_000 + "a" * 300_000 + "@" * 1000) == []
    assert pii.field_spans(["1" * 100_000 + " " + "@" * 100_000], pii.train()) == [[]]


def test_field_finds_held_out_forms_and_leaves_others():
    field = pii.train()

    def found(text):
        return [(kind, text[a:b]) for a, b, kind in pii.field_spans([text], field)[0]]

    assert found("please call (523) 555-1055 tomorrow") == [("contact", "(523) 555-1055")]
    assert found("mail to max [at] web [dot] de today") == [("mailbox", "max [at] web [dot] de")]
    assert found("iban DE12 5001 0517 0648 4898 90 danke") == [("account", "DE12 5001 0517 0648 4898 90")]
    for clean in ("in 1998 and 2004 about 1,200 people came", "version 2.10.3 of 2021-05-17 at 10:45", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"):
        assert found(clean) == []


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = pii.train()
    many = [rng.normal(size=(n, len(pii.LABELS))) for n in (1, 3, 2, 4)]
    start = np.array([-1e4 if x[0] == "I" else 0 for x in pii.LABELS])
    for scores, path in zip(many, pii.viterbi(many, field.transition)):
        def value(p):
            return start[p[0]] + sum(scores[i][k] for i, k in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:]))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(scores)), key=value)
        assert abs(value(best) - value(path)) < 1e-9


def test_rows_and_masking(spark):
    rows = [(1, "write a.b@c.de or 1.2.3.4"), (2, None), (3, ""), (3, ""), (None, "+1 (743) 555-3824"), (5, "call (523) 555-1055 now")]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:6:14,ip:18:25")
    assert got[2].spans == got[3].spans == "" and got[None].n_phone == 1
    assert got[5].n_phone == 0 and got[5].spans == "contact:5:19"
    df = docs(spark, rows)
    masked = pii.mask_personal_data(df)
    assert masked.columns == df.columns and masked.count() == 6
    assert {r.text for r in masked.where("doc_id = 1").collect()} == {"write <email> or <ip>"}
    assert pii.find_personal_data(docs(spark, [])).count() == 0
