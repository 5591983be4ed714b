"""Each query on empty tables, on nulls and odd texts, and with extra columns whose names clash."""

from __future__ import annotations

import pytest

from weblattice.llm import registry

ALL = registry.queries()
LONG = "The quiet archive of the old team keeps one list of pages for members. " * 1500


def odd_tables() -> dict:
    texts = [None, "", " ", "\n\n", "x", LONG, LONG, "cafÃ© �", "½ ² İ Σ \U0001f600 \U00010107", "a\nb\na\nb", "-" * 300, "{{ name }}", "\x00 \x01 controls", "1 2 3 " * 100]
    ids = [None, 1, *range(1, 13)]
    return {
        "sites": [{"id": i} for i in (None, 1, 2, 2, 3)],
        "pages": [{"id": i, "site_id": s, "current_version_id": v} for i, s, v in ((None, None, None), (1, 1, 1), (2, 1, 2), (3, 2, 3), (3, 2, 3), (4, None, 4), (5, 2, None), (6, 9, 99))],
        "page_versions": [{"id": i, "page_id": (i or 0) % 6 if i != 4 else None, "title": t, "text": t} for i, t in zip(ids, texts)],
        "links": [{"src_page_id": s, "dst_site_id": d, "anchor_text": a} for s, d, a in ((None, None, None), (1, 1, ""), (1, 1, ""), (2, None, "x"), (77, 1, None))],
        "entities": [{"page_version_id": 1, "site_id": s, "kind": k, "value": v} for s, k, v in ((1, "pgp", None), (None, "pgp", "a"), (1, None, "a"), (1, "email", " "), (1, " Email", "mailto: a@b "), (2, "EMAIL", "A@B"), (2, "EMAIL", "A@B"), (99, "email", "a@b"))],
        "documents": [{"doc_id": i, "text": t, "lang": lang, "source": s} for i, t, lang, s in zip(ids, texts, [None, "", "und", "EN", "xx-yy", "-", " ", "english"] * 2, [None, "", "a", "a", "b"] * 3)],
        "eval_items": [{"item_id": i, "text": t} for i, t in ((None, LONG), (1, None), (2, ""), (3, "too short"), (4, LONG[:200]), (4, LONG[:200]))],
        "lang_samples": [{"lang": a, "text": t} for a, t in ((None, "x"), ("en", None), ("en", "The list is kept by the old team of the archive."), ("de", "Die Liste ist in dem Archiv der alten Gruppe."), ("de", ""))],
        "mix_targets": [{"source": s, "target_share": w, "max_repeats": n} for s, w, n in ((None, 0.1, 1), ("a", 0.5, 2), ("b", 0.0, 3), ("none", 0.3, 4), ("b-c", None, 1), ("", 0.2, 0))],
    }


@pytest.mark.parametrize("name", ALL)
def test_empty_tables_give_no_rows(spark, folder, name):
    assert ALL[name](spark, folder()).count() == 0


CLASH = "a b n v u m id page_id site_id version_id text title same sig key rep rank line line_no k1 k2 g2 source_key chars bytes ended cut phrase tokens budget epochs rest taken place bucket jaccard group_id kind value lang confidence stuffed spam n_links"


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_do_no_harm_and_extra_columns_change_nothing(spark, folder, name):
    t = odd_tables()
    plain = sorted(map(repr, ALL[name](spark, folder(**t)).collect()))
    if name.endswith("_found"):
        assert len(plain) == len(set(plain))
    assert plain == sorted(map(repr, ALL[name](spark, folder(extra=CLASH, **t)).collect()))
