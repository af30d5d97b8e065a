"""The sequencing rules, one operation at a time over plain rows; for small worlds."""

from collections import defaultdict

UPLOAD_EVICT, EVICT_1, UPLOAD_KEEP, SHUTTLE, EVICT_2, DOWNLOAD, EVICT_3 = range(1, 8)


def plain_sequence(needs, evicts, replicas, locations, reserve):
    """Per library the ordered (kind, blob_id, file_id, src, dest, staging); all arguments are lists of dicts."""
    places = {(p["library_id"], p["location_id"]): dict(p) for p in locations}
    free = {k: p["free_bytes"] for k, p in places.items()}
    usable = {k: free[k] - (reserve if p["kind"] == "volume" else 0) for k, p in places.items()}
    waiting = defaultdict(list)
    for n in needs:
        waiting[n["op_class"]].append(n)
    spare, done, gone = list(evicts), [], []
    have, unmet, uploaded = defaultdict(int), defaultdict(int), {}
    for r in replicas:
        if r["state"] == "verified" and r["hydration"] != "placeholder" and r["is_online"]:
            have[r["library_id"], r["blob_id"]] += 1

    def move(key, size):
        free[key] += size
        usable[key] += size

    def hop(library, size):
        for shuttle in (True, False):
            some = [(-free[k], k[1]) for k, p in places.items() if k[0] == library and p["kind"] == "volume" and p["is_online"]
                    and not p["is_overlay"] and p["is_shuttle"] == shuttle]
            if some and usable[library, min(some)[1]] >= size:
                return min(some)[1]
        return None

    def transfer(kind, round_no, step):
        staged = [(n, hop(n["library_id"], n["size"]) if kind == "shuttle" else None) for n in waiting[kind]]
        left = {k: u for k, u in usable.items()}
        taken = []
        for n, via in sorted(staged, key=lambda x: (-x[0]["size"], x[0]["blob_id"], x[0]["dest"])):
            key = n["library_id"], n["dest"]
            if (kind != "shuttle" or via) and n["size"] <= left[key]:
                left[key] -= n["size"]
                taken.append((n, via))
        for n, via in taken:
            waiting[kind].remove(n)
            move((n["library_id"], n["dest"]), -n["size"])
            blob = n["library_id"], n["blob_id"]
            have[blob] += 1
            if step == UPLOAD_EVICT:
                uploaded[blob] = max(uploaded.get(blob, ""), n["dest"])
            done.append((round_no, step, n, via))
        stuck = kind == "shuttle" and any(via is None for n, via in staged if n in waiting[kind])
        return len(taken), stuck

    def evict(round_no, step):
        reading = {(n["library_id"], n["src_file_id"]) for some in waiting.values() for n in some if n["src_kind"] == "volume"}
        number, taken = defaultdict(int), []
        for e in sorted(spare, key=lambda e: e["file_id"]):
            blob = e["library_id"], e["blob_id"]
            if (e["library_id"], e["file_id"]) in reading:
                continue
            number[blob] += 1
            if have[blob] - number[blob] >= max(1, min(e["min_replicas"], e["n_goals"] - unmet[blob])):
                pair = uploaded.get(blob) if step == EVICT_1 and number[blob] == 1 else None
                taken.append((e, pair))
        for e, pair in taken:
            spare.remove(e)
            move((e["library_id"], e["location_id"]), e["size"])
            have[e["library_id"], e["blob_id"]] -= 1
            gone.append((round_no, UPLOAD_EVICT if pair else step, e, pair))
        return len(taken)

    any_evict, round_no = bool(spare), 1
    moved, _ = transfer("upload_evict", 1, UPLOAD_EVICT)
    copies, space, shuttle_waits = True, True, True
    if any_evict and evict(1, EVICT_1):
        copies = False
    copies = transfer("upload_keep", 1, UPLOAD_KEEP)[0] > 0 or (copies and moved > 0)
    while True:
        if space and shuttle_waits:
            n, shuttle_waits = transfer("shuttle", round_no, SHUTTLE)
            copies = n > 0 or copies
        if copies and any_evict:
            space = evict(round_no, EVICT_2) > 0 or space
        copies = False
        loaded = transfer("download", round_no, DOWNLOAD)[0] if space else 0
        space = loaded > 0 and any_evict and evict(round_no, EVICT_3) > 0
        if not space:
            soft = [n for n in waiting["download"] if n["keep_local"] == "prefer" and n["dest_kind"] == "volume"]
            if not soft:
                break
            for n in soft:
                waiting["download"].remove(n)
                unmet[n["library_id"], n["blob_id"]] += 1
            copies = True
        round_no += 1

    pairs = {(e["library_id"], e["blob_id"], pair) for _, _, e, pair in gone if pair}
    rows = []
    for r, step, n, via in done:
        kind = n["op_class"]
        if kind == "upload_evict" and (n["library_id"], n["blob_id"], n["dest"]) not in pairs:
            kind = "upload_keep"
        rows.append((n["library_id"], r, step, -n["size"], n["blob_id"], n["dest"], 0, n["src_file_id"], (kind, n["src"], n["dest"], via)))
    for r, step, e, pair in gone:
        rows.append((e["library_id"], r, step, -e["size"], e["blob_id"], pair or e["location_id"], 1, e["file_id"], ("evict", e["location_id"], None, None)))
    out = defaultdict(list)
    for row in sorted(rows, key=lambda x: x[:8]):
        kind, src, dest, via = row[8]
        out[row[0]].append((kind, row[4], row[7], src, dest, via))
    return dict(out)
