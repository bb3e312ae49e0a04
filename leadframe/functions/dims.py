"""Static dimensions: channel labels in display order, annotation codes, palette."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Channel labels by group, in display order.
LEADS: dict[str, tuple[str, ...]] = {
    "ECG": ("I", "II", "III", "AVF", "AVL", "AVR", "V1", "V2", "V3", "V4", "V5", "V6"),
    "HRA": ("RA 3-4", "RA 1-2"),
    "HIS": ("HIS PROXIMAL", "HIS PROX", "HIS P", "HIS MIDDLE", "HIS MID", "HIS M", "HIS DISTAL", "HIS DIST", "HIS D", "HIS 5-6", "HIS 3-4", "HIS 1-2"),
    "CS": ("CS 9-10", "CS 7-8", "CS 5-6", "CS 3-4", "CS 1-2"),
    "DD": ("DD 19-20", "DD 17-18", "DD 15-16", "DD 13-14", "DD 11-12", "DD 9-10", "DD 7-8", "DD 5-6", "DD 3-4", "DD 1-2"),
    "RV": ("RV 3-4", "RV 1-2"),
    "ABL": ("ABL PROXIMAL", "ABL PROX", "ABL P", "ABL DISTAL", "ABL DIST", "ABL D", "ABL 3-4", "ABL 1-2"),
}
SURFACE = LEADS["ECG"]
LABELS: tuple[str, ...] = tuple(x for group in LEADS.values() for x in group)
SOURCES = ("ECG", "HRA", "RA", "HIS", "CS", "DD", "RV", "ABL")

# Annotation codes of the Waveform Database with symbol, mnemonic and description.
ANNOTATIONS: tuple[tuple[int, str, str, str], ...] = (
    (0, " ", "NOTANN", "Not an actual annotation"),
    (1, "N", "NORMAL", "Normal beat"),
    (2, "L", "LBBB", "Left bundle branch block beat"),
    (3, "R", "RBBB", "Right bundle branch block beat"),
    (4, "a", "ABERR", "Aberrated atrial premature beat"),
    (5, "V", "PVC", "Premature ventricular contraction"),
    (6, "F", "FUSION", "Fusion of ventricular and normal beat"),
    (7, "J", "NPC", "Nodal (junctional) premature beat"),
    (8, "A", "APC", "Atrial premature contraction"),
    (9, "S", "SVPB", "Premature or ectopic supraventricular beat"),
    (10, "E", "VESC", "Ventricular escape beat"),
    (11, "j", "NESC", "Nodal (junctional) escape beat"),
    (12, "/", "PACE", "Paced beat"),
    (13, "Q", "UNKNOWN", "Unclassifiable beat"),
    (14, "~", "NOISE", "Signal quality change"),
    (16, "|", "ARFCT", "Isolated QRS-like artifact"),
    (18, "s", "STCH", "ST change"),
    (19, "T", "TCH", "T-wave change"),
    (20, "*", "SYSTOLE", "Systole"),
    (21, "D", "DIASTOLE", "Diastole"),
    (22, '"', "NOTE", "Comment annotation"),
    (23, "=", "MEASURE", "Measurement annotation"),
    (24, "p", "PWAVE", "P-wave peak"),
    (25, "B", "BBB", "Left or right bundle branch block"),
    (26, "^", "PACESP", "Non-conducted pacer spike"),
    (27, "t", "TWAVE", "T-wave peak"),
    (28, "+", "RHYTHM", "Rhythm change"),
    (29, "u", "UWAVE", "U-wave peak"),
    (30, "?", "LEARN", "Learning"),
    (31, "!", "FLWAV", "Ventricular flutter wave"),
    (32, "[", "VFON", "Start of ventricular flutter/fibrillation"),
    (33, "]", "VFOFF", "End of ventricular flutter/fibrillation"),
    (34, "e", "AESC", "Atrial escape beat"),
    (35, "n", "SVESC", "Supraventricular escape beat"),
    (36, "@", "LINK", "Link to external data (aux_note contains URL)"),
    (37, "x", "NAPC", "Non-conducted P-wave (blocked APB)"),
    (38, "f", "PFUS", "Fusion of paced and normal beat"),
    (39, "(", "WFON", "Waveform onset"),
    (40, ")", "WFOFF", "Waveform end"),
    (41, "r", "RONT", "R-on-T premature ventricular contraction"),
)

# The material palette, light to dark; surface and duodecapolar leads use each shade twice.
_PINK = ["#FCE4EB", "#F8BAD0", "#F38EB1", "#F06192", "#EB3F79", "#E91E63", "#D81A5F", "#C1185A", "#AC1357", "#870D4E"]
_BLUE = ["#E3F2FD", "#BADEFA", "#90CAF8", "#64B4F6", "#41A5F4", "#2096F2", "#1E87E5", "#1976D2", "#1465BF", "#0C46A0"]
_TEAL = ["#DFF2F1", "#B2DFDA", "#7FCBC4", "#4CB6AC", "#26A599", "#009687", "#00887A", "#00796B", "#00685B", "#004C3F"]
_YELLOW = ["#FFFDE6", "#FFF8C4", "#FFF49D", "#FFF176", "#FFED58", "#FFEB3A", "#FDD834", "#FABF2C", "#F8A725", "#F47F17"]
PALETTE: dict[str, list[str]] = {
    "HIS": _YELLOW, "HRA": _PINK, "RV": _PINK, "ABL": _PINK, "CS": _TEAL,
    "ECG": [c for c in _BLUE for _ in range(2)], "DD": [c for c in _TEAL for _ in range(2)],
}


def lead_dim(spark: SparkSession) -> DataFrame:
    """(``label``, ``lead_group``, ``ord``) for the known channel labels, in display order."""
    group = {x: g for g, xs in LEADS.items() for x in xs}
    return spark.createDataFrame([(x, group[x], i) for i, x in enumerate(LABELS)], "label string, lead_group string, ord int")


def annotation_dim(spark: SparkSession, symbols: list[str] | None = None, codes: list[int] | None = None) -> DataFrame:
    """(``label_store``, ``symbol``, ``mnemonic``, ``description``), all or those of given symbols and codes."""
    df = spark.createDataFrame(list(ANNOTATIONS), "label_store int, symbol string, mnemonic string, description string")
    if symbols is not None:
        df = df.filter(df["symbol"].isin(symbols))
    return df if codes is None else df.filter(df["label_store"].isin(codes))


def palette_dim(spark: SparkSession, mode: str = "dark", palette: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(``lead_group``, ``i``, ``color``); the light mode takes the shades from dark to light."""
    rows = [(g, i, c) for g, cs in (PALETTE if palette is None else palette).items() for i, c in enumerate(reversed(cs) if mode == "light" else cs)]
    return spark.createDataFrame(rows, "lead_group string, i int, color string")
