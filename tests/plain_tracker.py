"""The rules of tracks, locks and reading again, one sequence and one frame at a time, in plain Python."""

import math
import re


def area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    union = area(a) + area(b) - shared
    return shared / union if union > 0 else 0.0


def apart(a, b, screen):
    x = ((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) / max(1, screen[0])
    y = ((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) / max(1, screen[1])
    return math.sqrt(x * x + y * y)


class PlainSequence:
    def __init__(self, s):
        self.s, self.tracks, self.last = s, [], 0
        self.lock = {"state": "SEARCH", "box": None, "age": 0, "unseen": 0, "track": 0, "score": 0.0, "confidence": 0.0}

    def score(self, t, frame):
        age = max(1, min(frame - t["born"] + 1, max(1, self.s.warmup)))
        steady = max(0.0, min(1.0, 1.0 - t["jitter"] / t["hits"] / 0.08))
        detector = min(1.0, t["detector"] / t["hits"] + 0.35 * t["channel"] / t["hits"])
        return (0.30 * min(1.0, t["hits"] / age) + 0.25 + 0.20 * steady + 0.15 * detector + 0.10 * min(1.0, t["ocr"] / t["hits"])) * max(
            0.0, 1.0 - t["missed"] / 6.0)

    def frame(self, number, screen, seen):
        """`seen`: (box, conf, class_id, detector) in order of arrival."""
        s, free = self.s, list(self.tracks)
        left = []
        for o in seen:
            best, gain = None, -1.0
            for t in free:
                overlap, distance = iou(o[0], t["box"]), apart(o[0], t["box"], screen)
                if (overlap >= s.match_iou or distance <= s.match_distance) and overlap + max(0.0, s.match_distance - distance) > gain:
                    best, gain = t, overlap + max(0.0, s.match_distance - distance)
            if best is None:
                left.append(o)
                continue
            free = [t for t in free if t is not best]
            best["jitter"] += apart(best["box"], o[0], screen)
            best["box"] = [(1.0 - s.alpha) * p + s.alpha * q for p, q in zip(best["box"], o[0])]
            best["missed"] = 0
            self.count(best, o)
        for t in free:
            t["missed"] += 1
        for o in left:
            self.last += 1
            self.tracks.append({"number": self.last, "box": list(o[0]), "born": number, "hits": 0, "missed": 0, "detector": 0, "ocr": 0,
                                "channel": 0, "confidence": 0.0, "jitter": 0.0})
            self.count(self.tracks[-1], o)
        self.tracks = [t for t in self.tracks if t["missed"] <= s.max_missed]
        self.tracks.sort(key=lambda t: -self.score(t, number))
        self.follow(number, screen)

    def count(self, t, o):
        t["hits"] += 1
        t["confidence"] += o[1]
        t["detector"] += o[3]
        t["ocr"] += not o[3]
        t["channel"] += o[2] in (0, 3)

    def lockable(self, t, number):
        return t["hits"] >= self.s.min_seen and self.score(t, number) >= self.s.stable_score and t["channel"] >= self.s.min_detector_support

    def follow(self, number, screen):
        s, lock = self.s, self.lock
        best = None
        for t in self.tracks:
            w, h = max(1.0, t["box"][2] - t["box"][0]), max(1.0, t["box"][3] - t["box"][1])
            share = area(t["box"]) / max(1.0, screen[0] * screen[1])
            if self.lockable(t, number) and 0 < share <= s.max_area and s.min_aspect <= w / h <= s.max_aspect:
                best = t
                break
        if best is not None:
            score = self.score(best, number)
            if best["hits"] >= s.lock_observations and score >= s.lock_score:
                if lock["state"] == "LOCKED" and lock["box"] and iou(best["box"], lock["box"]) < s.lock_iou and apart(
                        best["box"], lock["box"], screen) > s.lock_distance:
                    return self.miss("LOCKED", s.lock_missed)
                lock.update(age=lock["age"] + 1 if lock["state"] == "LOCKED" else 1, state="LOCKED", box=list(best["box"]), unseen=0,
                            track=best["number"], score=max(0.0, min(1.0, score)), confidence=best["confidence"] / best["hits"])
                return None
            if best["hits"] > 1:
                lock.update(state="LOCK_CANDIDATE", unseen=0, track=best["number"], score=max(0.0, min(1.0, score)))
                return None
        if lock["state"] in ("LOCKED", "LOCK_CANDIDATE"):
            return self.miss(lock["state"], s.lock_missed)
        if lock["state"] == "UNLOCK_COOLDOWN":
            lock["unseen"] += 1
            if lock["unseen"] > 1:
                lock.update(state="SEARCH", unseen=0)
        return None

    def miss(self, state, limit):
        self.lock["unseen"] += 1
        self.lock["state"] = state
        if self.lock["unseen"] > limit:
            self.lock.update(state="UNLOCK_COOLDOWN", box=None, age=0, track=0, score=0.0, confidence=0.0)


WINDOWS = [("history_original", .88), ("history_pad_1p10", .86), ("history_pad_1p25", .84), ("history_left_leading_zero_pad", .87),
           ("history_right_pad", .82), ("history_vertical_pad", .80)]


def windows(lock, screen, max_area=0.18):
    w, h = screen

    def clamp(x1, y1, x2, y2):
        return tuple(max(0.0, min(float(m), v)) for v, m in ((x1, w), (y1, h), (x2, w), (y2, h)))

    x1, y1, x2, y2 = clamp(*lock)
    bw, bh = max(1.0, x2 - x1), max(1.0, y2 - y1)
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2

    def scaled(fx, fy):
        hw, hh = max(1.0, (x2 - x1) * fx / 2), max(1.0, (y2 - y1) * fy / 2)
        return clamp(cx - hw, cy - hh, cx + hw, cy + hh)

    boxes = {"history_original": (x1, y1, x2, y2), "history_pad_1p10": scaled(1.1, 1.1), "history_pad_1p25": scaled(1.25, 1.18),
             "history_left_leading_zero_pad": clamp(x1 - .35 * bw, y1 - .1 * bh, x2 + .12 * bw, y2 + .1 * bh),
             "history_right_pad": clamp(x1 - .15 * bw, y1 - .1 * bh, x2 + .28 * bw, y2 + .1 * bh),
             "history_vertical_pad": clamp(x1 - .1 * bw, y1 - .3 * bh, x2 + .1 * bw, y2 + .3 * bh)}
    out = []
    for kind, score in sorted(WINDOWS, key=lambda k: -k[1]):
        box = boxes[kind]
        if area(box) > 0 and area(box) / max(1.0, w * h) <= max_area and not any(iou(box, o) > 0.92 for _, _, o in out):
            out.append((kind, score, box))
    return out


def reread(lock, screen, predict, min_conf, max_digits, most):
    """Readings where the lock was: (value, box, conf, kind, boost); `predict(kind, box)` gives (value, conf) pairs or None."""
    best = {}
    for kind, score, box in windows(lock["box"], screen):
        if round(box[2]) <= round(box[0]) or round(box[3]) <= round(box[1]):
            continue
        for value, conf in predict(kind, box) or ():
            spot = (value, *map(round, box))
            if conf >= min_conf and 1 <= len(value) <= max_digits and (spot not in best or best[spot][2] < conf):
                boost = max(0.0, min(1.0, 0.55 * score + 0.45 * lock["score"]))
                best[spot] = (value, tuple(round(v, 3) for v in box), round(conf, 6), kind, round(boost, 6))
    return sorted(best.values(), key=lambda r: -r[2])[:most]


def numeric_like(text):
    return 1 <= len(re.sub("[^0-9]", "", text)) <= 4 and not re.search(r"(?i)\b\d{1,2}\s*:\s*\d{2}\b|am|pm", text)
