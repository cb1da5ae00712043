"""Word lists, thresholds, patterns and texts that decide results."""

# --- fixed values: column-name hints -------------------------------------
NUMERIC_HINTS = [
    "revenue", "sales", "sale", "amount", "total", "price", "cost", "profit",
    "qty", "quantity", "volume", "discount", "units",
]
REVENUE_LIKE_HINTS = ["revenue", "sales", "sale", "amount", "total", "gmv", "income"]
ROLE_HINTS = {
    "date": ["date", "day", "week", "month", "quarter", "year", "order", "invoice", "transaction"],
    "revenue": ["revenue", "sales", "sale", "amount", "total", "income", "gmv", "gross", "net"],
    "price": ["price", "unit", "rate", "ticket"],
    "quantity": ["qty", "quantity", "units", "volume", "count"],
    "category": ["category", "segment", "department", "channel", "product", "line", "division"],
    "region": ["region", "market", "territory", "state", "city", "country", "area"],
}

# --- fixed values: text tokens a CSV scan reads as null --------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: thresholds ------------------------------------------------
LOW_CARDINALITY_FLOOR = 12
LOW_CARDINALITY_RATIO = 0.2
NUMERIC_CANDIDATE_RATIO = 0.6
QUALITY_SCORE_MIN = 0.75
DUPLICATE_PERCENT_MAX = 0.10
SCHEMA_CONFIDENCE_MIN = 0.8
LOW_CONFIDENCE_WARNING = 0.85
ANOMALY_THRESHOLD = 1.5
ROLLING_WINDOW = 3
BREAKDOWN_LIMIT = 10
PREVIEW_LIMIT = 8
PROMPT_MAX_CHARS = 1500
MESSAGE_MAX_CHARS = 1000

# --- fixed values: report id -------------------------------------------------
REPORT_ID_PATTERN = "^[a-f0-9]{12}$"

# --- fixed values: gate reasons and warnings ---------------------------------
REASON_QUALITY = "Data quality too low"
REASON_SCHEMA = "Schema confidence too low"
REASON_NO_ROWS = "CSV contains no usable rows after removing empty rows and columns."
WARN_DUPLICATES_HIGH = "High duplicate rate detected"
WARN_DUPLICATES = "Duplicate rows were removed before analysis"
WARN_NEGATIVE = "Negative revenue anomalies detected"
WARN_LOW_CONFIDENCE = "Revenue column inferred with low confidence"
HIDDEN_WARNING_PARTS = ["unable to reach ollama", "dataset quality score"]

# --- fixed values: report texts ----------------------------------------------
REPORT_TITLE = "KPI Report"
UNAVAILABLE = "unavailable"
GENERIC_MARKERS = [
    "the agent generated", "approved analytics tools", "tool-augmented",
    "the model writes", "this report is grounded",
]
REPORT_QUESTIONS = [
    "Which anomaly date should I inspect first?",
    "Do you want a category breakdown?",
    "Should I compare the latest period against the previous one?",
]
CHAT_QUESTIONS = [
    "Which anomaly date should I inspect first?",
    "Do you want a category or region breakdown?",
    "Should I regenerate charts for a different view?",
]
PANEL_QUESTIONS = ["Why is growth 0%?", "Which category performed best?", "Show regional trends"]
DEFAULT_QUESTIONS = [
    "Which fields failed validation?",
    "What anomalies were detected?",
    "Should I inspect the cleaned preview?",
]
GATE_CHAT_ANSWER = (
    "This report failed the trust gate, so chat-based analysis is disabled until the data is fixed."
)

# --- fixed values: report sentences; {name} marks a value ---------------------
CHART_FACT_LINE = (
    "The trend chart runs from {first} to {last}, with the latest plotted revenue at {value}."
)
CHART_FACT_RANKED = "The {title} is led by {leader} at {value}."
SUMMARY_TOTAL = (
    "Total revenue is {total} across {rows} cleaned rows, with average revenue of {average}."
)
SUMMARY_LATEST = (
    "The latest grouped period is {latest}, and its revenue change versus the previous period is {growth}."
)
SUMMARY_ANOMALIES = "{count} anomaly dates were detected in the grouped revenue series."
SUMMARY_NO_ANOMALIES = "No anomaly dates were detected in the grouped revenue series."
SUMMARY_QUALITY = "Dataset quality score is {score}."
INSIGHT_BASELINE = (
    "Total revenue reached {total}, while average revenue per cleaned row was {average}."
)
INSIGHT_MOVEMENT = "The latest grouped period ({latest}) recorded a growth rate of {growth}. "
INSIGHT_ANOMALIES = "{count} anomaly dates were flagged, including {dates}."
INSIGHT_NO_ANOMALIES = "No anomaly dates were flagged in the grouped revenue trend."
INSIGHT_NO_CHART = (
    "Chart outputs are available, but no ranked category or region takeaway was available "
    "from the current chart set."
)
INSIGHT_QUALITY = "Dataset quality score is {score} with no major validation warnings."
NO_WARNINGS = "No major validation warnings were raised."
STORY_OVERVIEW = (
    "The report covers {rows} cleaned rows with total revenue of {total} and average revenue of {average}. "
)
STORY_NO_CHART = "The chart set reflects the same cleaned data used for the KPI totals."
STORY_TREND = (
    "In the latest grouped period ({latest}), revenue changed by {growth} versus the previous period. "
)
STORY_ANOMALIES = "{count} anomaly dates were detected, including {dates}."
STORY_NO_ANOMALIES = "No anomaly dates were detected in the grouped revenue pattern."
STORY_QUALITY = (
    "Dataset quality score is {score}. No major validation warnings were raised in the trust checks."
)
STORY_NO_WARNINGS = "No major validation warnings were raised in the trust checks."
STORY_HEADLINES = {
    "overview": "Revenue, growth, and chart outputs line up on the same cleaned report data.",
    "trend": "Recent movement should be read through the grouped revenue series.",
    "risk": "Data quality and exceptions still shape how confidently the report should be read.",
}
DUPLICATE_RATE = "Duplicate rate after validation: {percent}%."
CHAT_ANSWER = (
    "Total revenue is {total}, growth rate is {growth}%, average revenue is {average}, "
    "and anomaly dates are {dates}."
)
CHAT_DUPLICATES = " Duplicate rate after validation was {percent}%."
GATE_TITLE, DEFAULT_TITLE = "Data Quality Gate Failed", "Trust-First KPI Report"
GATE_SUMMARY = "{reason} Review the quality warnings before retrying."
GATE_SUMMARY_REASON = "Report generation was blocked."
DEFAULT_SUMMARY = "Report generated successfully."
GATE_STORY = {
    "eyebrow": "Pipeline Blocked",
    "headline": "The pipeline stopped before KPI generation.",
    "copy": "The uploaded data did not pass the quality gate.",
}
DEFAULT_STORY = {
    "eyebrow": "Method",
    "headline": "Results were generated from one cleaned and validated dataset.",
    "copy": "Validation, schema detection, KPI calculation, and charts all used the same cleaned dataframe.",
}
HIDDEN_RISK_PART = "dataset quality score is 1"

# --- fixed values: tool-call records -----------------------------------------
TOOL_METHOD = "tools/call"
TOOL_NAMES = ["calculate_kpis", "generate_chart"]
CHART_TYPES = ["line", "bar", "pie"]
METRIC_NAMES = [
    "revenue", "sales", "profit", "cost", "units_sold", "signups", "churn_rate", "active_users",
    "conversion_rate", "ad_spend", "orders", "refunds", "sessions", "impressions", "clicks",
]
METRIC_VARIANTS = {
    "revenue": ["Revenue ($)", "revenu", "TOTAL_REVENUE", "rev_usd", "Revenue  ", "Total Revenue"],
    "sales": ["Sales Qty", "sales#", "SALES", "sale_amount", "Sales (units)"],
    "profit": ["Net Profit", "profit_margin_$", "Profit/Loss", "PnL"],
    "cost": ["Cost ($)", "COGS", "total_cost", "Cost_USD"],
    "units_sold": ["Units Sold", "units", "qty_sold", "Units-Sold"],
}
DATE_HEADERS = ["date", "Date", "week_ending", "period", "Week", "report_date", "DATE (YYYY-MM-DD)"]
CATEGORY_HEADERS = ["region", "Region", "product", "category", "channel", "store_id", "segment"]
NOISE_TAGS = [
    "mixed_date_formats", "currency_symbols", "null_values", "duplicate_header_row",
    "trailing_whitespace_headers", "non_english_headers", "numeric_strings", "outlier_rows",
    "inconsistent_casing", "merged_cells_artifact",
]
KPI_TEMPLATES = [
    "Can you build this week's report from {file}?",
    "Generate the KPI summary for {file}.",
    "What's our {metric} trend looking like this quarter?",
    "Give me revenue growth and anomalies from this dataset.",
    "Summarize performance for {file}.",
    "I need the weekly business report -- KPIs plus a chart.",
    "Analyze {file} and flag anything unusual.",
    "What are the top-line numbers from this data?",
]
CHART_TEMPLATES = [
    "Just show me a {chart_type} chart of {metric} over time.",
    "Plot {metric} by {category} as a {chart_type} chart.",
    "Can you visualize the {metric} trend?",
]
NO_TOOL_QUERIES = [
    "What does KPI stand for?",
    "How do you calculate churn rate in general?",
    "What's the difference between a bar chart and a pie chart?",
    "Can you explain what an anomaly flag means in a report?",
    "Is revenue the same thing as profit?",
    "What formats does the app accept for upload?",
    "Thanks, that report looks great!",
    "Can you explain your methodology without re-running the analysis?",
]
MULTI_STEP_QUERY = "Give me the full report: KPIs plus a chart of the main trend."
NO_TOOL_ANSWER = (
    "That's a general question, so I don't need to run any tools -- happy to explain directly."
)
PUBLIC_NO_TOOL_ANSWER = "That request doesn't need a tool call -- happy to help directly."
TOOL_SYSTEM_PROMPT = """You are an analysis agent. You have access to these tools:

1. calculate_kpis(metrics: list[str], date_column: str, detect_anomalies: bool) -> KPI summary with growth, averages, trends, anomaly flags
2. generate_chart(metric: str, chart_type: "line"|"bar"|"pie", group_by: str|null) -> chart payload

Rules:
- Only call a tool when the user's request requires computing or visualizing data from the uploaded CSV.
- If the user asks a general/conceptual question that does not require the data, respond with plain text and do NOT call a tool.
- When calling a tool, respond with ONLY a JSON object in this exact shape, no other text:
{"tool_calls": [{"method": "tools/call", "params": {"name": "<tool_name>", "arguments": {...}}}]}
- Use the canonical column names given in the schema, not the raw noisy header text.
- If both KPIs and a chart are requested, include both calls in the same tool_calls list, KPI call first.
"""
PUBLIC_SYSTEM_PROMPT = """You are an AI assistant that can call external tools when needed.
Available tools are provided in each conversation as a JSON list.
Rules:
- Only call a tool when the request requires it; otherwise answer in plain text.
- When calling a tool, respond with ONLY a JSON object: {"tool_calls": [{"method": "tools/call", "params": {"name": "<tool_name>", "arguments": {...}}}]}
"""

# --- fixed values: request protocol ------------------------------------------
REQUEST_VERSION = "2.0"
REQUEST_METHODS = ["initialize", "tools/list", "tools/call"]
ERROR_INVALID_REQUEST = -32600
ERROR_METHOD_NOT_FOUND = -32601
ERROR_DATASET_REQUIRED = -32000
