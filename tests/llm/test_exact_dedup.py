import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tablelens.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = Counter()
    for r in rows:
        ids = groups[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out[(r[0], keep, len(ids), hashlib.sha256(norm(r[1]).encode()).hexdigest())] += 1
    return out


def check(got, rows):
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {k[3] for k in expected(rows)}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_awkward_rows(odd, odd_rows):
    check(exact_dedup.exact_duplicates(odd).collect(), odd_rows)


def test_collisions_are_told_apart_by_bytes(odd, odd_rows):
    weak = lambda c: F.substring(F.md5(c), 1, 1)
    check(exact_dedup.exact_duplicates(odd, digest=weak).collect(), odd_rows)
    check(exact_dedup.exact_duplicates(odd, digest=lambda c: F.lit("same")).collect(), odd_rows)


def test_kept_rows_carry_their_columns(odd, odd_rows):
    kept = exact_dedup.without_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(r[1]) for r in odd_rows})


def test_empty(none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.without_duplicates(none).count() == 0
