"""The order-cargo rules row by row in plain Python, the yardstick for both Spark forms."""

FACTS = {
    ("60010", "60020"): "pay_suc", ("60020", "60030"): "receive", ("60040", "60050"): "dispatch",
    ("60050", "60060"): "bound_finish", ("60060", "60070"): "deliver", ("60070", "60080"): "sign",
}


def simulate(rows, ttl_ms=5000, clear_on=("cancel", "sign")):
    """rows: (order_id, tbl, op, ms, s0, s1, cargo_id) -> list of (order_id, fact, cargo_id, status, update_ms)."""
    out, held, waiting = [], {}, {}
    for oid, tbl, op, ms, s0, s1, cargo in sorted(rows, key=lambda r: (r[3], r[1], r[2], r[5] or "", r[6] or "")):
        if oid is None:
            continue
        if tbl == "order_cargo":
            held[oid] = cargo
            if oid in waiting and ms - waiting[oid][1] < ttl_ms:
                out.append((oid, "detail", cargo, *waiting[oid]))
        elif op == "c":
            if oid in held:
                out.append((oid, "detail", held[oid], s1, ms))
            else:
                waiting[oid] = (s1, ms)
        elif op == "u" and oid in held:
            fact = FACTS.get((s0, s1)) or ("cancel" if s1 == "60999" else None)
            if fact:
                out.append((oid, fact, held[oid], s1, ms))
            if fact in clear_on:
                del held[oid]
    return out
