"""Signal tables of small made-up recordings."""

from tidemark.detectors.base import TABLES, Signals

#: Two pictures more than 48 bits apart, and as many more as are asked for.
A, B = ([0] * 16, 3), ([-1] * 16, 28)


def picture(n):
    return ([0x5555 << (n % 48)] * 8 + [(0x0F0F0F0F << (n * 3 % 31)) ^ n * 7919] * 8, n % 32)


class Build:
    def __init__(self):
        self.rows = {k: [] for k in TABLES}

    def recording(self, rec, duration, has_video=True, has_audio=False, width=320, height=240, channels=0, error=None):
        self.rows["recordings"].append((rec, f"/media/{rec}.mp4", float(duration), has_video, has_audio, width, height, channels, 25.0, error))
        return self

    def frames(self, rec, pictures, fps=2.0):
        for i, (h, b) in enumerate(pictures):
            self.rows["frame_samples"].append((rec, i, int(i * 1000 / fps), i / fps, h, b))
        return self

    def levels(self, rec, values, window=0.5, peak=-18.0, flat=0.0):
        for i, v in enumerate(values):
            self.rows["level_windows"].append((rec, i, round(i * window * 1000), i * window, (i + 1) * window, float(v), peak, flat))
        return self

    def channels(self, rec, values, window=0.5):
        for i, v in enumerate(values):
            self.rows["channel_windows"].append((rec, i, round(i * window * 1000), i * window, (i + 1) * window, {k + 1: float(x) for k, x in enumerate(v)}))
        return self

    def segment(self, rec, kind, start, end):
        self.rows["measured_segments"].append((rec, kind, float(start), float(end), float(end - start)))
        return self

    def spectral(self, rec, rows):
        self.rows["spectral_windows"] += [(rec, float(t), float(f), float(c), float(r)) for t, f, c, r in rows]
        return self

    def signals(self, spark):
        return Signals(spark, {k: spark.createDataFrame(v, TABLES[k]) for k, v in self.rows.items() if v})
