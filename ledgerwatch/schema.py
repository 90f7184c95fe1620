"""Schemas, feature sets and the fixed values shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# The log's columns and their types.
TXN_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.ByteType()),
        T.StructField("isFlaggedFraud", T.ByteType()),
    ]
)

# Transaction types that can be fraudulent, with their model codes.
TYPE_CODES = {"TRANSFER": 1, "CASH_OUT": 2}

# Model features in model order. The four balance columns
# marked below leak the label and are left out of the realistic set.
BALANCE_FEATURES = ("orig_balance_diff", "dest_balance_diff", "orig_zero_after", "dest_unchanged")
VELOCITY_FEATURES = ("velocity_cumcount", "velocity_1hr", "velocity_3hr", "velocity_24hr")
REQUEST_FEATURES = (
    "step",
    "type_encoded",
    "amount",
    "log_amount",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
)
FULL_FEATURES = REQUEST_FEATURES + BALANCE_FEATURES + VELOCITY_FEATURES
REALISTIC_FEATURES = REQUEST_FEATURES + VELOCITY_FEATURES
LABEL = "isFraud"
FEATURE_TABLE = FULL_FEATURES + (LABEL,)

# Display name of each realistic feature.
FEATURE_LABELS = {
    "step": "Hour of transaction",
    "type_encoded": "Transaction type",
    "amount": "Amount ($)",
    "log_amount": "Log amount",
    "oldbalanceOrg": "Origin balance (before)",
    "newbalanceOrig": "Origin balance (after)",
    "oldbalanceDest": "Dest balance (before)",
    "newbalanceDest": "Dest balance (after)",
    "velocity_cumcount": "Cumulative txn count",
    "velocity_1hr": "Txns same hour",
    "velocity_3hr": "Txns same 3hr window",
    "velocity_24hr": "Txns same day",
}

# Fields of a request, and the tools of an investigation with their display names.
REQUEST_FIELDS = (
    "step",
    "type",
    "amount",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
    "velocity_cumcount",
    "velocity_1hr",
    "velocity_3hr",
    "velocity_24hr",
)
TOOL_LABELS = {
    "tool_run_fraud_model": "Run Fraud Model",
    "tool_explain_prediction": "Explain Prediction",
    "tool_check_account_velocity": "Check Account Velocity",
    "tool_retrieve_regulations": "Retrieve Regulations",
}

# Limits and cut-offs.
FIRST_STEP, LAST_STEP = 1, 743
EXPLAIN_THRESHOLD = 0.4
VELOCITY_FLAG_ABOVE = 5
MEDIUM_SHARE = 0.6
MIN_CHUNK_CHARS = 50
MAX_PASSAGE_CHARS = 500
CHUNK_ROWS = 500_000
AMOUNT_CLIP = 1_000_000.0
