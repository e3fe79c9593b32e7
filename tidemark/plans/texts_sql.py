"""What findings say, and the words of a report, as SQL of their own: nothing here is read from the texts that the library uses."""

from __future__ import annotations

#: (language, variant, observations, interpretation), with facts in braces. Fixed values.
SENTENCES = [
    ("en", "blackout", ["Video was measured as fully black for {duration:.2f}s."], "Possible blackout (signal loss, source cut to black unexpectedly) or an intentional black transition. The recording alone does not establish intent."),
    ("en", "freeze_alone", ["Video showed no measurable change for {duration:.2f}s."], "Possible freeze / signal stall, or a genuinely static shot. No audio track was available to help distinguish these."),
    ("en", "freeze_active", ["Video showed no measurable change for {duration:.2f}s.", "Audio remained active during this interval."], "Likely a normal static camera shot: audio activity continued throughout, which is inconsistent with a technical freeze."),
    ("en", "freeze_quiet", ["Video showed no measurable change for {duration:.2f}s.", "Audio was near-silent during this interval."], "Possible video freeze / signal stall: no visual change and no audio activity for a sustained period."),
    ("en", "clipping", ["Audio peak level reached {peak:.2f} dBFS with a flat-top waveform factor of {flat:.1f} for {duration:.2f}s."], "Possible audio clipping (input gain too high, or a mixer/encoder overload)."),
    ("en", "dropout", ["Audio level dropped to near-silence ({level:.1f} dBFS or below) for {duration:.2f}s.", "Audio was active for at least {context:.1f}s immediately before this interval.", "Audio was active again for at least {context:.1f}s immediately after this interval."], "Possible audio dropout (microphone or channel interruption) rather than an intentional pause, based on the surrounding audio activity. This cannot be distinguished from a very short deliberate pause with certainty from levels alone."),
    ("en", "channel_missing", ["Channel levels diverged for {duration:.2f}s (at end of interval: {levels})."], "Possible dropped microphone/channel or a routing fault: one channel was active while another was near-silent for a sustained period. This can also be an intentionally mono source routed to a single channel; the recording alone cannot distinguish these."),
    ("en", "channel_imbalance", ["Channel levels diverged for {duration:.2f}s (at end of interval: {levels})."], "Sustained level imbalance between channels. Could be a genuine routing/gain issue, or an intentional mix choice (e.g. a panned source); human review recommended."),
    ("en", "rollback_confirmed", ["Slide state {s0} was displayed for {d0:.2f}s.", "Slide state {s1} then appeared for {d1:.2f}s.", "The recording returned to slide state {s0} for {d2:.2f}s.", "Slide state {s1} appeared again afterward, this time for {d3:.2f}s."], "Consistent with a premature slide advance followed by an operator/presenter correction: the first appearance of the later slide was brief compared to its return."),
    ("en", "rollback_brief", ["Slide state {s0} was displayed for {d0:.2f}s.", "Slide state {s1} then appeared for {d1:.2f}s.", "The recording returned to slide state {s0} for {d2:.2f}s."], "Consistent with a premature slide advance and correction, but the sequence did not repeat afterward to confirm the pattern."),
    ("en", "rollback_long", ["Slide state {s0} was displayed for {d0:.2f}s.", "Slide state {s1} then appeared for {d1:.2f}s.", "The recording returned to slide state {s0} for {d2:.2f}s."], "Slide state was revisited, but the intervening slide was displayed for a substantial duration -- this looks more consistent with an intentional return to a previous slide than a correction."),
    ("en", "rollback_long_repeat", ["Slide state {s0} was displayed for {d0:.2f}s.", "Slide state {s1} then appeared for {d1:.2f}s.", "The recording returned to slide state {s0} for {d2:.2f}s.", "Slide state {s1} appeared again afterward, this time for {d3:.2f}s."], "Slide state was revisited, but the intervening slide was displayed for a substantial duration -- this looks more consistent with an intentional return to a previous slide than a correction."),
    ("en", "brief", ["Slide state {state} was displayed for only {duration:.2f}s, between slide state {previous} and slide state {next}."], "Possible unintended brief slide appearance (premature advance, accidental click, or animation step captured as a separate state). Could also be a fast, intentional flip through reference material."),
    ("en", "progress_audio", ["No meaningful visual change was detected for the interval.", "The slide/presentation state did not change during the interval.", "Audio remained near-silent for the interval."], "Possible event progression interruption: no camera motion, no audio activity, and no slide change were observed together for an extended period. This could also be an intermission, a technical pause acknowledged by the room, or a long silent activity (e.g. audience working on a task) that this recording cannot distinguish."),
    ("en", "progress_alone", ["No meaningful visual change was detected for the interval.", "The slide/presentation state did not change during the interval.", "No audio track was available to corroborate this."], "Possible event progression interruption: no camera motion, no audio activity, and no slide change were observed together for an extended period. This could also be an intermission, a technical pause acknowledged by the room, or a long silent activity (e.g. audience working on a task) that this recording cannot distinguish."),
    ("en", "feedback", ["A narrow-band spectral peak near {frequency:.0f} Hz persisted for {duration:.2f}s.", "Peak-band energy concentration reached {concentration:.0%} of total in-band energy."], "Possible audio feedback/howling. This is an experimental, heuristic detector based on narrow-band spectral persistence; it cannot reliably distinguish this from a sustained musical note, test tone, or room resonance, and requires human review."),
    ("ja", "blackout", ["映像が完全な黒画面として{duration:.2f}秒間計測されました。"], "信号断・意図しない黒画面への切り替わりの可能性、または意図的な黒転換の可能性があります。この録画データだけでは意図の有無は判断できません。"),
    ("ja", "freeze_alone", ["映像に{duration:.2f}秒間、計測可能な変化がありませんでした。"], "映像のフリーズ(信号停止)の可能性、または単に静止したカットの可能性があります。判別に使える音声トラックがありませんでした。"),
    ("ja", "freeze_active", ["映像に{duration:.2f}秒間、計測可能な変化がありませんでした。", "この区間、音声は活動を継続していました。"], "通常の静止カットである可能性が高いです。区間中も音声の活動が続いており、技術的なフリーズとは整合しません。"),
    ("ja", "freeze_quiet", ["映像に{duration:.2f}秒間、計測可能な変化がありませんでした。", "この区間、音声はほぼ無音でした。"], "映像のフリーズ(信号停止)の可能性があります: 一定時間、映像の変化も音声の活動も検出されませんでした。"),
    ("ja", "clipping", ["音声のピークレベルが{peak:.2f} dBFSに達し、波形の頭打ち(フラット)係数{flat:.1f}の状態が{duration:.2f}秒間続きました。"], "音声のクリッピング(音割れ)の可能性があります(入力ゲイン過大、またはミキサー・エンコーダーの過負荷など)。"),
    ("ja", "dropout", ["音声レベルがほぼ無音まで低下し、{duration:.2f}秒間続きました。", "この区間の直前、一定時間は音声が活動していました。", "この区間の直後も、一定時間は音声が活動を再開していました。"], "意図的な間ではなく、マイクや回線の瞬断による音声ドロップアウトの可能性があります(周囲の音声活動から判断)。ただし、レベル情報だけでは非常に短い意図的な間との確実な区別はできません。"),
    ("ja", "channel_missing", ["チャンネル間でレベル差が{duration:.2f}秒間続きました(区間終了時点: {levels})。"], "マイクやチャンネルの脱落、または回線の不具合の可能性があります: 一方のチャンネルが活動している間、もう一方はほぼ無音の状態が続きました。意図的にモノラル音声を片方のチャンネルにルーティングしている場合も同じ見え方になるため、この録画データだけでは区別できません。"),
    ("ja", "channel_imbalance", ["チャンネル間でレベル差が{duration:.2f}秒間続きました(区間終了時点: {levels})。"], "チャンネル間で持続的なレベル差があります。本当のルーティング/ゲインの問題の可能性もあれば、意図的なミックス(パンを振った音源など)の可能性もあります。人間による確認を推奨します。"),
    ("ja", "rollback_confirmed", ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。", "その後、再びスライド状態{s1}が{d3:.2f}秒間表示されました。"], "早すぎるスライド送りの後、発表者/オペレーターが元に戻して修正した可能性と一致します: 後のスライドの最初の表示が、戻った後の表示に比べて短時間でした。"),
    ("ja", "rollback_brief", ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。"], "早すぎるスライド送りとその修正の可能性と一致しますが、この後同じパターンが繰り返されておらず、パターンの確証は得られていません。"),
    ("ja", "rollback_long", ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。"], "スライド状態への再訪問が検出されましたが、間に挟まったスライドの表示時間が長く、修正というより意図的な過去スライドへの遷移である可能性が高いです。"),
    ("ja", "rollback_long_repeat", ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。", "その後、再びスライド状態{s1}が{d3:.2f}秒間表示されました。"], "スライド状態への再訪問が検出されましたが、間に挟まったスライドの表示時間が長く、修正というより意図的な過去スライドへの遷移である可能性が高いです。"),
    ("ja", "brief", ["スライド状態がわずか{duration:.2f}秒間しか表示されませんでした(スライド状態{previous}とスライド状態{next}の間)。"], "意図しない短時間のスライド表示の可能性があります(早すぎるスライド送り、誤操作によるクリック、または別の状態として捉えられたアニメーションの一コマなど)。参考資料をすばやく意図的にめくった可能性も考えられます。"),
    ("ja", "progress_audio", ["この区間、意味のある映像の変化は検出されませんでした。", "この区間、スライド/プレゼンテーションの状態は変化しませんでした。", "この区間、音声はほぼ無音の状態が続きました。"], "イベント進行の中断の可能性があります: カメラの動き・音声の活動・スライドの変化のいずれも、長時間にわたって観測されませんでした。休憩、会場が把握している技術的な中断、または長時間の無音の作業(観客が課題に取り組んでいる、など)である可能性も考えられ、この録画データだけでは区別できません。"),
    ("ja", "progress_alone", ["この区間、意味のある映像の変化は検出されませんでした。", "この区間、スライド/プレゼンテーションの状態は変化しませんでした。", "これを裏付けるための音声トラックがありませんでした。"], "イベント進行の中断の可能性があります: カメラの動き・音声の活動・スライドの変化のいずれも、長時間にわたって観測されませんでした。休憩、会場が把握している技術的な中断、または長時間の無音の作業(観客が課題に取り組んでいる、など)である可能性も考えられ、この録画データだけでは区別できません。"),
    ("ja", "feedback", ["約{frequency:.0f} Hzの狭帯域スペクトルのピークが{duration:.2f}秒間持続しました。", "ピーク帯域のエネルギー集中度は帯域内全エネルギーの{concentration:.0%}に達しました。"], "音声のフィードバック/ハウリングの可能性があります。これは実験的なヒューリスティック検出器であり、持続的な楽音・テストトーン・部屋の共鳴などとの確実な区別はできません。人間による確認が必要です。"),
]

#: (language, kind, key, word) of a report. Fixed values.
WORDS = [
    ("en", "severity", "low", "low"), ("en", "severity", "medium", "medium"), ("en", "severity", "high", "high"),
    ("ja", "severity", "low", "低"), ("ja", "severity", "medium", "中"), ("ja", "severity", "high", "高"),
    ("en", "category", "video", "video"), ("en", "category", "audio", "audio"), ("en", "category", "presentation", "presentation"), ("en", "category", "progress", "progress"),
    ("ja", "category", "video", "映像"), ("ja", "category", "audio", "音声"), ("ja", "category", "presentation", "プレゼンテーション"), ("ja", "category", "progress", "進行"),
]

#: The parts of a Markdown report, by language. Fixed values.
PARTS = {
    "en": {
        "title": "Event Recording Audit", "file": "File", "duration": "Duration", "total": "Total findings", "timeline": "Timeline", "detailed": "Detailed findings", "no_findings": "No anomaly candidates were detected.",
        "table": "| Time | Duration | Category | Severity | Confidence | Type |", "category": "Category", "confidence": "Confidence", "detector": "Detector", "observed": "Observed", "meant": "Possible interpretation",
        "review": "Human verification required.", "limitations": "Limitations", "none": "(none)", "unknown": "unknown", "high": "high", "medium": "medium", "low": "low",
    },
    "ja": {
        "title": "収録監査レポート", "file": "ファイル", "duration": "収録時間", "total": "検出件数", "timeline": "タイムライン", "detailed": "詳細な検出内容", "no_findings": "異常の候補は検出されませんでした。",
        "table": "| 時刻 | 長さ | カテゴリ | 深刻度 | 確信度 | 種別 |", "category": "カテゴリ", "confidence": "確信度", "detector": "検出器", "observed": "観測事実", "meant": "考えられる解釈",
        "review": "人間による確認が必要です。", "limitations": "制限事項・注意点", "none": "(なし)", "unknown": "不明", "high": "高", "medium": "中", "low": "低",
    },
}


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows(values: list[tuple]) -> str:
    """Tuples of strings and lists of strings as rows of a VALUES list."""
    cell = lambda x: "[" + ", ".join(map(literal, x)) + "]" if isinstance(x, list) else literal(x)
    return ", ".join("(" + ", ".join(map(cell, v)) + ")" for v in values)


#: Facts in the sentences and how they are written.
FORMATS = {
    "duration": ".2f", "peak": ".2f", "flat": ".1f", "level": ".1f", "context": ".1f", "frequency": ".0f", "concentration": ".0%", "levels": "",
    "s0": "", "s1": "", "d0": ".2f", "d1": ".2f", "d2": ".2f", "d3": ".2f", "state": "", "previous": "", "next": "",
}


def filled(template: str = "t") -> str:
    """SQL of a sentence with its facts, which are columns of these names."""
    for fact, form in FORMATS.items():
        mark = "{" + fact + (f":{form}" if form else "") + "}"
        value = f"printf('%.0f%%', 100 * {fact})" if form == ".0%" else f"printf('%{form}', {fact})" if form else f"{fact}::VARCHAR"
        template = f"replace({template}, '{mark}', coalesce({value}, ''))"
    return template


def clock(seconds: str) -> str:
    """SQL of HH:MM:SS.mmm, to the nearest millisecond."""
    ms = f"round_even({seconds} * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def findings(sources: list[tuple[str, str, dict[str, str]]]) -> str:
    """SQL of the union of (relation, SQL of the variant, facts), each relation with recording_id, type, start and end; a fact that a finding lacks is null."""
    one = lambda relation, variant, facts: f"SELECT recording_id, type, \"start\", \"end\", {variant} AS variant, " + ", ".join(f"{facts.get(f, 'NULL')}::{'VARCHAR' if f == 'levels' else 'BIGINT' if f in ('s0', 's1', 'state', 'previous', 'next') else 'DOUBLE'} AS {f}" for f in FORMATS) + f" FROM {relation}"
    return " UNION ALL ".join(one(*s) for s in sources)
