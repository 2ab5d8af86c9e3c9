"""Result store and request control over events (event_id, ts, user_id, event_type, value, props), as plans."""

from __future__ import annotations

TUMBLING = "SELECT CAST(FLOOR(EPOCH(ts) / 3600) AS BIGINT) AS hour, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY CAST(FLOOR(EPOCH(ts) / 3600) AS BIGINT), event_type"
JOINED_RESULTS = "SELECT c.c_custkey, c.c_name, COALESCE(r.n, 0) AS n_results, ROUND(COALESCE(r.total, 0.0), 2) AS total FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) r ON c.c_custkey = r.o_custkey"
