"""Fixed values.

Everything in this module must equal the measurement platform being re-expressed, because the
outputs (column names, indicator labels, event types, effect sizes) are compared against it.
They are stated plainly, in natural order, and used unchanged by the operators.
"""

from __future__ import annotations

# --- fixed values: event types counted in the interaction fact ---------------------------
EVENT_TYPES = ("delivered", "opened", "clicked", "reported")

# --- fixed values: message signals (fact column -> key inside the template's signals JSON) ---
SIGNAL_KEYS = {
    "signal_urgency": "urgencia",
    "signal_authority": "autoridad",
    "signal_reward": "recompensa",
    "signal_personalization": "personalizacion",
}
SIGNAL_COLUMNS = tuple(SIGNAL_KEYS)
# JSON string values counted as "signal present"; JSON numbers equal to 1 and JSON true count too.
TRUTHY_STRINGS = ("1", "true", "True")

# --- fixed values: signal labels of the with/without comparison table ---------------------
SIGNAL_LABELS = {
    "signal_urgency": "Urgencia",
    "signal_authority": "Autoridad",
    "signal_reward": "Recompensa",
    "signal_personalization": "Personalización",
}

# --- fixed values: model features and label ------------------------------------------------
DEMOGRAPHIC_COLUMNS = ("age_bracket", "gender", "education")
FEATURE_COLUMNS = SIGNAL_COLUMNS + DEMOGRAPHIC_COLUMNS
TARGET_COLUMN = "clicked_flag"
CLEAN_TEXT_COLUMNS = ("age_bracket", "gender", "education", "template_name", "template_subject")

# --- fixed values: label normalisation (lower-cased, trimmed text -> 0/1) ---------------------
LABEL_TEXT_MAP = {
    "true": 1,
    "false": 0,
    "yes": 1,
    "no": 0,
    "sí": 1,
    "si": 1,
    "1": 1,
    "0": 0,
}

# --- fixed values: tokens pandas.read_csv reads as missing by default -------------------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: general table indicator labels, in output order --------------------------
GENERAL_INDICATORS = (
    "Total de observaciones",
    "Total de campañas",
    "Total de targets",
    "Total de segmentos",
    "Total de plantillas",
    "Correos entregados",
    "Aperturas registradas",
    "Clics registrados",
    "Reportes registrados",
    "Tasa de apertura (%)",
    "Tasa de clic (%)",
    "Tasa de reporte (%)",
)

# --- fixed values: global summary indicator names, in output order --------------------------
GLOBAL_INDICATORS = (
    "total_rows",
    "total_campaigns",
    "total_targets",
    "total_segments",
    "total_templates",
    "total_delivered",
    "total_opened",
    "total_clicked",
    "open_rate_pct",
    "click_rate_pct",
)

# --- fixed values: template validation ---------------------------------------------------------
REQUIRED_PLACEHOLDERS = ("{{ landing_url }}", "{{ tracking_dot }}")
RECOMMENDED_PLACEHOLDERS = ("{{ report_url }}",)

# --- fixed values: synthetic population effects (logit scale) ----------------------------------
AGE_EFFECT = {"18-24": 0.35, "25-34": 0.20, "35-44": 0.05, "45-54": -0.05, "55+": -0.10}
EDUCATION_EFFECT = {"Secundaria": 0.30, "Tecnica": 0.15, "Universitaria": -0.05, "Posgrado": -0.15}
GENDER_EFFECT = {"F": 0.02, "M": 0.00}
# open score = -1.0 + age + 0.5*education + gender + signal weights, clamped to [0.02, 0.95]
OPEN_INTERCEPT = -1.0
OPEN_EDUCATION_SCALE = 0.5
OPEN_SIGNAL_WEIGHTS = {
    "signal_personalization": 0.20,
    "signal_authority": 0.12,
    "signal_reward": 0.10,
    "signal_urgency": 0.08,
}
OPEN_CLAMP = (0.02, 0.95)
# click score = -2.0 + 0.9*age + education + gender + signal weights (+0.20 urgency x authority),
# clamped to [0.01, 0.85]
CLICK_INTERCEPT = -2.0
CLICK_AGE_SCALE = 0.9
CLICK_SIGNAL_WEIGHTS = {
    "signal_urgency": 0.30,
    "signal_authority": 0.28,
    "signal_reward": 0.24,
    "signal_personalization": 0.18,
}
CLICK_URGENCY_AUTHORITY_BONUS = 0.20
CLICK_CLAMP = (0.01, 0.85)

# synthetic population design: five ages x two genders x four educations = 40 segments
AGE_BRACKETS = ("18-24", "25-34", "35-44", "45-54", "55+")
EDUCATIONS = ("Secundaria", "Tecnica", "Universitaria", "Posgrado")

# --- fixed values: scenario probabilities (p_open, p_click_given_open) ------------------------
SCENARIOS = ("control", "personalization", "segment", "interaction")
CONTROL_P = (0.32, 0.18)
PERSONALIZATION_P_OPEN = {"personalized": 0.48, "other": 0.26}
PERSONALIZATION_P_CLICK = 0.18
SEGMENT_P_OPEN = 0.32
SEGMENT_P_CLICK = {"experimental": 0.35, "other": 0.12}
INTERACTION_P_OPEN = {
    "experimental_personalized": 0.60,
    "personalized": 0.40,
    "experimental": 0.30,
    "other": 0.25,
}
INTERACTION_P_CLICK = 0.18
EXPERIMENTAL_SEGMENT_ID = 1

# --- fixed values: scenario validation labels --------------------------------------------------
SCENARIO_ROWS = {
    "control": ("Control", "Apertura: personalización vs sin personalización",
                "Con personalización", "Sin personalización", "Sin diferencia deliberada"),
    "personalization": ("Personalización", "Apertura: personalización vs sin personalización",
                        "Con personalización", "Sin personalización",
                        "Mayor apertura con personalización"),
    "segment": ("Segmento", "Clic: segmento experimental vs otros segmentos",
                "Segmento experimental", "Otros segmentos",
                "Mayor clic en segmento experimental"),
    "interaction": ("Interacción", "Efecto diferencial de personalización por segmento",
                    "Efecto personalización en segmento experimental",
                    "Efecto personalización en otros segmentos",
                    "Mayor efecto de personalización en segmento experimental"),
}

# --- fixed values: hit routes of the tracker ---------------------------------------------------
HIT_ROUTES = {"/open.gif": "opened", "/r": "clicked", "/report": "reported"}

# --- fixed values: dataset source labels ----------------------------------------------------
SOURCE_OBSERVED = "observed"
SOURCE_SYNTHETIC = "synthetic"
SOURCE_COMBINED = "combined"
SOURCE_SCENARIO = "synthetic_scenario"
