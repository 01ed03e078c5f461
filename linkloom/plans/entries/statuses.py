"""Status transitions and deletions."""

from linkloom import scale
from linkloom.operators import status, worklists
from linkloom.plans.catalog import add

TRANSIENT = "(error_code IS NULL OR error_code IN (429, 500, 502, 503, 504))"
FIELDS = ["id", "status", "title", "error", "error_code", "processed_at", "changed"]


def _oracle(where: str, values: dict[str, str]) -> str:
    cells = [
        f"CASE WHEN {where} THEN {values[c]} ELSE {c} END AS {c}" if c in values else c for c in FIELDS[1:-1]
    ]
    return f"SELECT id, {', '.join(cells)}, {where} AS changed FROM urls"


FRESH = {"status": "'pending'", "title": "NULL", "error": "NULL", "processed_at": "NULL"}
RETRY = {"status": "'pending'", "error": "NULL", "error_code": "NULL", "processed_at": "NULL"}
SOME_URL = "https://m.ththth.example.net/en/25#top"

add("m1_reset_all", lambda t: status.reset_all(t.urls).select(*FIELDS), "urls", _oracle("true", FRESH))
add("m2_reset_errors", lambda t: status.reset_errors(t.urls).select(*FIELDS), "urls", _oracle("(status = 'error')", RETRY))
add(
    "m3_reset_transient",
    lambda t: status.reset_transient_errors(t.urls).select(*FIELDS),
    "urls",
    _oracle(f"(status = 'error' AND {TRANSIENT})", RETRY),
)
add(
    "m3_affected",
    lambda t: scale.affected(status.reset_transient_errors(t.urls)),
    "urls",
    f"SELECT count(*) AS affected FROM urls WHERE status = 'error' AND {TRANSIENT}",
)
add("m4_defer_all", lambda t: status.defer_errors(t.urls).select(*FIELDS), "urls", _oracle("(status = 'error')", {"status": "'deferred'"}))
add(
    "m4_defer_codes",
    lambda t: status.defer_errors(t.urls, [403, 410]).select(*FIELDS),
    "urls",
    _oracle("(status = 'error' AND coalesce(error_code, 0) IN (403, 410))", {"status": "'deferred'"}),
)
add("m5_undefer", lambda t: status.undefer_all(t.urls).select(*FIELDS), "urls", _oracle("(status = 'deferred')", {"status": "'error'"}))
add("m6_reset_url", lambda t: status.reset_url(t.urls, SOME_URL).select(*FIELDS), "urls", _oracle(f"(url = '{SOME_URL}')", FRESH))
add("m7_delete_urls", lambda t: status.delete_urls(t.urls, t.doomed), "urls doomed", "SELECT * FROM urls WHERE id NOT IN (SELECT id FROM doomed)")
add(
    "m7_delete_cascade",
    lambda t: status.delete_results(t.latest, t.doomed),
    "model_results doomed",
    "SELECT * FROM model_results WHERE url_id NOT IN (SELECT id FROM doomed)",
)
add("m8_urls_by_ids", lambda t: worklists.urls_by_ids(t.urls, t.doomed), "urls doomed", "SELECT id, url FROM urls WHERE id IN (SELECT id FROM doomed)")
