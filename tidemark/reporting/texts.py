"""Words of the reports: labels, and what each kind of finding says. Fixed values throughout."""

from __future__ import annotations

LANGUAGES = ("en", "ja")

#: table -> key -> (en, ja). Fixed values.
LABELS = {
    "ui": {
        "title": ("Event Recording Audit", "収録監査レポート"),
        "file": ("File", "ファイル"),
        "duration": ("Duration", "収録時間"),
        "total_findings": ("Total findings", "検出件数"),
        "timeline": ("Timeline", "タイムライン"),
        "detailed_findings": ("Detailed findings", "詳細な検出内容"),
        "no_findings": ("No anomaly candidates were detected.", "異常の候補は検出されませんでした。"),
        "col_time": ("Time", "時刻"),
        "col_duration": ("Duration", "長さ"),
        "col_category": ("Category", "カテゴリ"),
        "col_severity": ("Severity", "深刻度"),
        "col_confidence": ("Confidence", "確信度"),
        "col_type": ("Type", "種別"),
        "details": ("details", "詳細"),
        "detector": ("Detector", "検出器"),
        "observed": ("Observed", "観測事実"),
        "possible_interpretation": ("Possible interpretation", "考えられる解釈"),
        "human_verification_required": ("Human verification required.", "人間による確認が必要です。"),
        "informational_entry": ("Informational entry; human verification not required.", "参考情報であり、確認は不要です。"),
        "no_interpretation": ("(insufficient evidence for an interpretation)", "(解釈を示すには根拠が不十分です)"),
        "evidence": ("Evidence", "証拠"),
        "limitations": ("Limitations", "制限事項・注意点"),
        "none": ("(none)", "(なし)"),
        "unknown_file": ("(unknown file)", "(不明なファイル)"),
        "unknown_duration": ("unknown", "不明"),
        "batch_title": ("Event Recording Audit — Batch Summary", "収録監査レポート — 複数会場サマリー"),
        "col_venue": ("Venue / File", "会場 / ファイル"),
        "col_status": ("Status", "ステータス"),
        "col_report": ("Report", "レポート"),
        "status_ok": ("ok", "正常"),
        "status_error": ("error", "エラー"),
        "total_venues": ("Venues processed", "処理した会場数"),
    },
    "severity": {"low": ("low", "低"), "medium": ("medium", "中"), "high": ("high", "高")},
    "confidence": {"low": ("low", "低"), "medium": ("medium", "中"), "high": ("high", "高")},
    "category": {
        "video": ("video", "映像"),
        "audio": ("audio", "音声"),
        "presentation": ("presentation", "プレゼンテーション"),
        "switching": ("switching", "切り替え"),
        "progress": ("progress", "進行"),
        "continuity": ("continuity", "連続性"),
        "post_production": ("post_production", "ポストプロダクション"),
    },
}

#: variant -> (observations, interpretation), filled from a finding's facts. Fixed values.
ENGLISH = {
    "blackout": (
        ["Video was measured as fully black for {duration:.2f}s."],
        "Possible blackout (signal loss, source cut to black unexpectedly) or an intentional black transition. The recording alone does not establish intent.",
    ),
    "freeze_alone": (
        ["Video showed no measurable change for {duration:.2f}s."],
        "Possible freeze / signal stall, or a genuinely static shot. No audio track was available to help distinguish these.",
    ),
    "freeze_active": (
        ["Video showed no measurable change for {duration:.2f}s.", "Audio remained active during this interval."],
        "Likely a normal static camera shot: audio activity continued throughout, which is inconsistent with a technical freeze.",
    ),
    "freeze_quiet": (
        ["Video showed no measurable change for {duration:.2f}s.", "Audio was near-silent during this interval."],
        "Possible video freeze / signal stall: no visual change and no audio activity for a sustained period.",
    ),
    "clipping": (
        ["Audio peak level reached {peak:.2f} dBFS with a flat-top waveform factor of {flat:.1f} for {duration:.2f}s."],
        "Possible audio clipping (input gain too high, or a mixer/encoder overload).",
    ),
    "dropout": (
        [
            "Audio level dropped to near-silence ({level:.1f} dBFS or below) for {duration:.2f}s.",
            "Audio was active for at least {context:.1f}s immediately before this interval.",
            "Audio was active again for at least {context:.1f}s immediately after this interval.",
        ],
        "Possible audio dropout (microphone or channel interruption) rather than an intentional pause, based on the surrounding audio activity. This cannot be distinguished from a very short deliberate pause with certainty from levels alone.",
    ),
    "channel_missing": (
        ["Channel levels diverged for {duration:.2f}s (at end of interval: {levels})."],
        "Possible dropped microphone/channel or a routing fault: one channel was active while another was near-silent for a sustained period. This can also be an intentionally mono source routed to a single channel; the recording alone cannot distinguish these.",
    ),
    "channel_imbalance": (
        ["Channel levels diverged for {duration:.2f}s (at end of interval: {levels})."],
        "Sustained level imbalance between channels. Could be a genuine routing/gain issue, or an intentional mix choice (e.g. a panned source); human review recommended.",
    ),
    "rollback_confirmed": (
        [
            "Slide state {s0} was displayed for {d0:.2f}s.",
            "Slide state {s1} then appeared for {d1:.2f}s.",
            "The recording returned to slide state {s0} for {d2:.2f}s.",
            "Slide state {s1} appeared again afterward, this time for {d3:.2f}s.",
        ],
        "Consistent with a premature slide advance followed by an operator/presenter correction: the first appearance of the later slide was brief compared to its return.",
    ),
    "rollback_brief": (
        ["Slide state {s0} was displayed for {d0:.2f}s.", "Slide state {s1} then appeared for {d1:.2f}s.", "The recording returned to slide state {s0} for {d2:.2f}s."],
        "Consistent with a premature slide advance and correction, but the sequence did not repeat afterward to confirm the pattern.",
    ),
    "rollback_long": (
        ["Slide state {s0} was displayed for {d0:.2f}s.", "Slide state {s1} then appeared for {d1:.2f}s.", "The recording returned to slide state {s0} for {d2:.2f}s."],
        "Slide state was revisited, but the intervening slide was displayed for a substantial duration -- this looks more consistent with an intentional return to a previous slide than a correction.",
    ),
    "rollback_long_repeat": (
        [
            "Slide state {s0} was displayed for {d0:.2f}s.",
            "Slide state {s1} then appeared for {d1:.2f}s.",
            "The recording returned to slide state {s0} for {d2:.2f}s.",
            "Slide state {s1} appeared again afterward, this time for {d3:.2f}s.",
        ],
        "Slide state was revisited, but the intervening slide was displayed for a substantial duration -- this looks more consistent with an intentional return to a previous slide than a correction.",
    ),
    "brief": (
        ["Slide state {state} was displayed for only {duration:.2f}s, between slide state {previous} and slide state {next}."],
        "Possible unintended brief slide appearance (premature advance, accidental click, or animation step captured as a separate state). Could also be a fast, intentional flip through reference material.",
    ),
    "progress_audio": (
        ["No meaningful visual change was detected for the interval.", "The slide/presentation state did not change during the interval.", "Audio remained near-silent for the interval."],
        "Possible event progression interruption: no camera motion, no audio activity, and no slide change were observed together for an extended period. This could also be an intermission, a technical pause acknowledged by the room, or a long silent activity (e.g. audience working on a task) that this recording cannot distinguish.",
    ),
    "progress_alone": (
        ["No meaningful visual change was detected for the interval.", "The slide/presentation state did not change during the interval.", "No audio track was available to corroborate this."],
        "Possible event progression interruption: no camera motion, no audio activity, and no slide change were observed together for an extended period. This could also be an intermission, a technical pause acknowledged by the room, or a long silent activity (e.g. audience working on a task) that this recording cannot distinguish.",
    ),
    "feedback": (
        ["A narrow-band spectral peak near {frequency:.0f} Hz persisted for {duration:.2f}s.", "Peak-band energy concentration reached {concentration:.0%} of total in-band energy."],
        "Possible audio feedback/howling. This is an experimental, heuristic detector based on narrow-band spectral persistence; it cannot reliably distinguish this from a sustained musical note, test tone, or room resonance, and requires human review.",
    ),
}

#: The same in Japanese. Fixed values.
JAPANESE = {
    "blackout": (
        ["映像が完全な黒画面として{duration:.2f}秒間計測されました。"],
        "信号断・意図しない黒画面への切り替わりの可能性、または意図的な黒転換の可能性があります。この録画データだけでは意図の有無は判断できません。",
    ),
    "freeze_alone": (
        ["映像に{duration:.2f}秒間、計測可能な変化がありませんでした。"],
        "映像のフリーズ(信号停止)の可能性、または単に静止したカットの可能性があります。判別に使える音声トラックがありませんでした。",
    ),
    "freeze_active": (
        ["映像に{duration:.2f}秒間、計測可能な変化がありませんでした。", "この区間、音声は活動を継続していました。"],
        "通常の静止カットである可能性が高いです。区間中も音声の活動が続いており、技術的なフリーズとは整合しません。",
    ),
    "freeze_quiet": (
        ["映像に{duration:.2f}秒間、計測可能な変化がありませんでした。", "この区間、音声はほぼ無音でした。"],
        "映像のフリーズ(信号停止)の可能性があります: 一定時間、映像の変化も音声の活動も検出されませんでした。",
    ),
    "clipping": (
        ["音声のピークレベルが{peak:.2f} dBFSに達し、波形の頭打ち(フラット)係数{flat:.1f}の状態が{duration:.2f}秒間続きました。"],
        "音声のクリッピング(音割れ)の可能性があります(入力ゲイン過大、またはミキサー・エンコーダーの過負荷など)。",
    ),
    "dropout": (
        ["音声レベルがほぼ無音まで低下し、{duration:.2f}秒間続きました。", "この区間の直前、一定時間は音声が活動していました。", "この区間の直後も、一定時間は音声が活動を再開していました。"],
        "意図的な間ではなく、マイクや回線の瞬断による音声ドロップアウトの可能性があります(周囲の音声活動から判断)。ただし、レベル情報だけでは非常に短い意図的な間との確実な区別はできません。",
    ),
    "channel_missing": (
        ["チャンネル間でレベル差が{duration:.2f}秒間続きました(区間終了時点: {levels})。"],
        "マイクやチャンネルの脱落、または回線の不具合の可能性があります: 一方のチャンネルが活動している間、もう一方はほぼ無音の状態が続きました。意図的にモノラル音声を片方のチャンネルにルーティングしている場合も同じ見え方になるため、この録画データだけでは区別できません。",
    ),
    "channel_imbalance": (
        ["チャンネル間でレベル差が{duration:.2f}秒間続きました(区間終了時点: {levels})。"],
        "チャンネル間で持続的なレベル差があります。本当のルーティング/ゲインの問題の可能性もあれば、意図的なミックス(パンを振った音源など)の可能性もあります。人間による確認を推奨します。",
    ),
    "rollback_confirmed": (
        ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。", "その後、再びスライド状態{s1}が{d3:.2f}秒間表示されました。"],
        "早すぎるスライド送りの後、発表者/オペレーターが元に戻して修正した可能性と一致します: 後のスライドの最初の表示が、戻った後の表示に比べて短時間でした。",
    ),
    "rollback_brief": (
        ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。"],
        "早すぎるスライド送りとその修正の可能性と一致しますが、この後同じパターンが繰り返されておらず、パターンの確証は得られていません。",
    ),
    "rollback_long": (
        ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。"],
        "スライド状態への再訪問が検出されましたが、間に挟まったスライドの表示時間が長く、修正というより意図的な過去スライドへの遷移である可能性が高いです。",
    ),
    "rollback_long_repeat": (
        ["スライド状態{s0}が{d0:.2f}秒間表示されました。", "続いてスライド状態{s1}が{d1:.2f}秒間表示されました。", "その後、スライド状態{s0}に戻り、{d2:.2f}秒間表示されました。", "その後、再びスライド状態{s1}が{d3:.2f}秒間表示されました。"],
        "スライド状態への再訪問が検出されましたが、間に挟まったスライドの表示時間が長く、修正というより意図的な過去スライドへの遷移である可能性が高いです。",
    ),
    "brief": (
        ["スライド状態がわずか{duration:.2f}秒間しか表示されませんでした(スライド状態{previous}とスライド状態{next}の間)。"],
        "意図しない短時間のスライド表示の可能性があります(早すぎるスライド送り、誤操作によるクリック、または別の状態として捉えられたアニメーションの一コマなど)。参考資料をすばやく意図的にめくった可能性も考えられます。",
    ),
    "progress_audio": (
        ["この区間、意味のある映像の変化は検出されませんでした。", "この区間、スライド/プレゼンテーションの状態は変化しませんでした。", "この区間、音声はほぼ無音の状態が続きました。"],
        "イベント進行の中断の可能性があります: カメラの動き・音声の活動・スライドの変化のいずれも、長時間にわたって観測されませんでした。休憩、会場が把握している技術的な中断、または長時間の無音の作業(観客が課題に取り組んでいる、など)である可能性も考えられ、この録画データだけでは区別できません。",
    ),
    "progress_alone": (
        ["この区間、意味のある映像の変化は検出されませんでした。", "この区間、スライド/プレゼンテーションの状態は変化しませんでした。", "これを裏付けるための音声トラックがありませんでした。"],
        "イベント進行の中断の可能性があります: カメラの動き・音声の活動・スライドの変化のいずれも、長時間にわたって観測されませんでした。休憩、会場が把握している技術的な中断、または長時間の無音の作業(観客が課題に取り組んでいる、など)である可能性も考えられ、この録画データだけでは区別できません。",
    ),
    "feedback": (
        ["約{frequency:.0f} Hzの狭帯域スペクトルのピークが{duration:.2f}秒間持続しました。", "ピーク帯域のエネルギー集中度は帯域内全エネルギーの{concentration:.0%}に達しました。"],
        "音声のフィードバック/ハウリングの可能性があります。これは実験的なヒューリスティック検出器であり、持続的な楽音・テストトーン・部屋の共鳴などとの確実な区別はできません。人間による確認が必要です。",
    ),
}

VARIANTS = {"en": ENGLISH, "ja": JAPANESE}


def label(table: str, key: str, language: str) -> str:
    """A word in the language; English where the language is unknown, the key where the word is."""
    entry = LABELS[table].get(key)
    return key if entry is None else entry[LANGUAGES.index(language) if language in LANGUAGES else 0]


def told(variant: str, facts: dict, levels: dict | None, language: str) -> tuple[list[str], str]:
    """(observations, interpretation) of a finding; English for unknown languages and for variants that a language lacks."""
    values = {k: int(v) if k in ("s0", "s1", "state", "previous", "next") else v for k, v in (facts or {}).items()}
    if levels:
        values["levels"] = ", ".join(f"ch{c}: {v:.1f} dBFS" for c, v in sorted(levels.items()))
    observations, interpretation = VARIANTS.get(language, ENGLISH).get(variant) or ENGLISH[variant]
    return [o.format(**values) for o in observations], interpretation
