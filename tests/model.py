"""A line-by-line account of what the window jobs must give, for small logs.

Rows are dicts in arrival order: host, pid, seq, kind, user, source_ip, port,
auth_method, invalid_user, ts.
"""


def walk(rows):
    """(opens, sessions, still_open, failures) of the rows."""
    accepted, current, pending = {}, {}, {}
    opens, sessions, failures = [], [], []
    for row in rows:
        key = (row["host"], row["pid"])
        kind = row["kind"]
        if kind == "accepted":
            accepted[key] = row
        elif kind == "session_opened":
            used = accepted.pop(key, None)
            login = [used[c] if used else "" for c in ("source_ip", "auth_method", "port")]
            current[key] = (row["seq"], row["user"], *login, row["ts"])
            opens.append((*key, *current[key]))
        elif kind == "session_closed":
            found = current.pop(key, None)
            if found:
                sessions.append((*key, *found, row["seq"], row["user"], row["ts"]))
        elif kind == "invalid_user" or (kind == "failed_password" and row["invalid_user"]):
            who = (row["user"], row["source_ip"])
            if key in pending and pending[key]["who"] == who:
                kept = pending.pop(key)
                if kind == "failed_password" and not kept["port"]:
                    kept["port"] = row["port"]
            else:
                pending[key] = {"seq": row["seq"], "who": who, "port": row["port"], "type": "invalid_user"}
                failures.append(pending[key])
        elif kind in ("failed_password", "max_auth"):
            name = "max_auth_exceeded" if kind == "max_auth" else kind
            port = "" if kind == "max_auth" else row["port"]
            failures.append({"seq": row["seq"], "who": (row["user"], row["source_ip"]), "port": port, "type": name})
    still = [(*key, *value) for key, value in current.items()]
    failed = [(f["seq"], *f["who"], f["port"], f["type"]) for f in failures]
    return opens, sessions, still, failed


def registry(rows, caps):
    """{dimension: [values in order]} after the rows, without merged reports' repeats."""
    seen = {d: [] for d in caps}

    def use(dimension, value):
        if value not in seen[dimension] and len(seen[dimension]) < caps[dimension]:
            seen[dimension].append(value)

    _, sessions, _, failed = walk(rows)
    counted = {f[0] for f in failed}
    paired = {s[7]: s for s in sessions}
    for row in rows:
        kind = row["kind"]
        if kind == "session_closed":
            pair = paired.get(row["seq"])
            if pair and pair[6] is not None and row["ts"] >= pair[6]:
                use("user", pair[3])
            use("user", row["user"])
        elif kind == "preauth_closed":
            use("source_ip", row["source_ip"])
        elif kind == "accepted" or row["seq"] in counted:
            use("user", row["user"])
            use("source_ip", row["source_ip"])
            if kind == "accepted":
                use("auth_method", row["auth_method"])
    return seen
