"""Names, words, cut-offs and sentences that define the published results.

Column names are compared after lower-casing and removing everything but letters and
digits, so one spelling stands for "customer_id", "Customer ID" and "customerID".
"""

# --- fixed values: column-name aliases of the roles a customer table can hold -------------
ROLE_ALIASES = {
    "customer_id": ["customer_id", "customer", "client_id", "account_id", "account_number"],
    "churn": [
        "churn", "is_churn", "churned", "exited", "exit", "attrition", "customer_status", "status",
    ],
    "tenure": ["tenure", "tenure_months", "months", "months_active", "customer_tenure"],
    "monthly_charges": ["monthly_charges", "monthly_charge", "monthly_cost", "monthly_fee"],
    "total_charges": ["total_charges", "total_charge", "total_cost", "lifetime_value"],
    "contract": ["contract", "contract_type", "plan", "plan_type", "subscription_type"],
    "payment_method": ["payment_method", "payment", "payment_type", "pay_method"],
}

# --- fixed values: roles of scored tables (dashboard, segments, recommendations) ----------
RESULT_ALIASES = {
    "prediction": ["Prediction", "Churn Prediction", "Predicted Churn", "Churn"],
    "predicted": ["Prediction", "Churn Prediction"],
    "probability": [
        "Churn Probability", "Probability", "Predicted Probability", "Churn Risk Probability",
        "Churn Prob",
    ],
    "risk_level": ["Risk Level", "Customer Risk Segment", "Risk Category"],
    "risk_score": ["Customer Risk Score", "Risk Score"],
    "segment": ["Strategic Segment", "Customer Segment"],
    "priority": ["Retention Priority"],
    "revenue_at_risk": ["Revenue At Risk"],
    "customer_value": ["Customer Value", "Total Charges"],
    "action": ["Recommended Action"],
    "recommendation": ["Retention Recommendation"],
    "customer_id": ["customer_id"],
    "contract": ["Contract", "Contract Type"],
    "payment_method": ["Payment Method"],
    "internet_service": ["Internet Service"],
    "gender": ["Gender"],
    "senior_citizen": ["Senior Citizen", "Senior"],
    "tenure": ["Tenure", "Customer Tenure", "Tenure Months"],
    "monthly_charges": ["Monthly Charges", "Monthly Charge"],
    "total_charges": ["Total Charges", "Total Charge"],
}

SERVICES = [
    "Phone Service", "Multiple Lines", "Online Security", "Online Backup",
    "Device Protection", "Tech Support", "Streaming TV", "Streaming Movies",
]
DRIVERS = [
    "Contract", "Payment Method", "Internet Service", "Gender", "Senior Citizen",
    "Partner", "Dependents", "Paperless Billing",
]

# --- fixed values: aliases of the signals used when scoring unlabelled tables -------------
SIGNAL_ALIASES = {
    "target": [
        "churn", "churned", "churn_flag", "churn_status", "churn_label", "churn_value",
        "customer_churn", "attrition", "attrition_flag", "attrition_status", "left",
        "customer_left", "cancelled", "canceled", "cancellation", "is_cancelled", "is_canceled",
        "subscription_cancelled", "subscription_canceled", "inactive", "is_inactive",
        "retained", "retention",
    ],
    "customer_id": [
        "customer_id", "customer", "customer_number", "customer_no", "client_id",
        "client_number", "account_id", "account_number", "user_id", "member_id",
        "subscriber_id", "subscription_id",
    ],
    "recency": [
        "days_since_last_activity", "days_since_last_login", "days_since_last_purchase",
        "days_since_last_transaction", "days_inactive", "inactive_days", "days_since_activity",
        "recency", "last_activity_days",
    ],
    "usage": [
        "usage", "monthly_usage", "total_usage", "login_count", "logins", "sessions",
        "session_count", "transactions", "transaction_count", "orders", "order_count",
        "purchase_count", "frequency", "engagement", "engagement_score", "activity",
        "activity_score",
    ],
    "tenure": [
        "tenure", "tenure_months", "months_with_company", "months_as_customer",
        "customer_tenure", "relationship_length", "relationship_months", "membership_months",
        "subscription_months", "duration",
    ],
    "support": [
        "support_tickets", "ticket_count", "tickets", "complaints", "complaint_count",
        "customer_complaints", "service_calls", "support_calls", "issues", "issue_count",
    ],
    "payment": [
        "late_payments", "late_payment_count", "payment_delays", "payment_delay", "overdue",
        "overdue_amount", "missed_payments", "payment_failures", "failed_payments", "delinquent",
    ],
    "spend": [
        "monthly_charges", "monthly_charge", "monthly_spend", "monthly_revenue", "revenue",
        "revenue_per_month", "total_spend", "total_revenue", "amount_spent", "purchase_value",
        "customer_value", "clv", "customer_lifetime_value", "arpu",
    ],
}
TARGET_KEYWORDS = ["churn", "attrition", "cancel", "cancellation", "left"]
REVERSED_TARGETS = ["retained", "retention"]

# --- fixed values: aliases of the universal profile ----------------------------------------
PROFILE_ALIASES = {
    "customer_id": [
        "customer_id", "client_id", "user_id", "account_id", "account_number", "customer_key",
        "member_id", "subscriber_id",
    ],
    "churn": [
        "churn", "churned", "churn_flag", "churn_status", "attrition", "attrited",
        "attrition_flag", "exited", "exit_flag", "customer_status", "customer_state",
        "left_company", "cancelled", "canceled", "is_churn",
    ],
    "tenure": ["tenure", "tenure_months", "months_active", "customer_age", "relationship_months"],
    "contract": ["contract", "contract_type", "subscription_type", "plan", "plan_type"],
    "payment": ["payment_method", "billing_method", "payment_type"],
    "monthly_value": [
        "monthly_charges", "monthly_charge", "monthly_spend", "monthly_revenue",
        "monthly_amount", "subscription_price", "mrr",
    ],
    "total_value": [
        "total_charges", "total_charge", "total_spend", "total_revenue", "total_amount",
        "lifetime_value", "ltv",
    ],
    "support": [
        "support", "tickets", "ticket_count", "complaints", "complaint_count", "issues",
        "issue_count",
    ],
    "usage": [
        "usage", "usage_hours", "logins", "login_count", "sessions", "session_count",
        "activity", "activity_score",
    ],
    "engagement": [
        "engagement", "engagement_score", "satisfaction", "satisfaction_score", "nps", "csat",
    ],
    "discount": [
        "discount", "discount_percent", "discount_amount", "offer", "promotion", "promo",
    ],
}

# --- fixed values: columns the scoring chain itself writes ---------------------------------
PRODUCED_COLUMNS = [
    "churn_prediction", "churn_probability", "risk_score", "risk_level", "prediction_method",
    "generated_customer_id", "customer_risk_score", "customer_value", "strategic_segment",
    "retention_priority", "priority_rank", "revenue_at_risk", "recommended_action",
    "retention_recommendation", "retention_urgency_score", "recommended_channel",
]

# --- fixed values: label words ---------------------------------------------------------------
CHURN_WORDS = [
    "yes", "y", "true", "1", "churn", "churned", "exited", "exit", "left", "attrited",
    "attrition", "cancelled", "canceled", "inactive", "lost", "terminated", "closed",
]
RETAIN_WORDS = [
    "no", "n", "false", "0", "retained", "retain", "active", "stayed", "stay", "not churned",
    "not_churned", "existing", "current", "loyal",
]
STATUS_CHURN = ["yes", "true", "1", "churn", "churned"]
STATUS_RETAINED = ["no", "false", "0", "retain", "retained", "active"]
MASK_EXTRA = ["high risk", "high-risk", "critical"]
PREDICTED_CHURN_WORDS = [
    "1", "yes", "true", "churn", "churned", "left", "cancelled", "canceled", "inactive", "attrited",
]
NULL_TOKENS = ["", "nan", "None", "NULL", "null", "N/A", "n/a", "NA"]
CURRENCY_PATTERN = "[,$₹€£]"
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

HIGH_RISK_WORDS = [
    "inactive", "cancel", "cancelled", "canceled", "complaint", "complaints", "poor", "low",
    "bad", "month-to-month", "monthly", "declined", "negative", "unhappy", "dissatisfied",
    "expired", "overdue", "late",
]
LOW_RISK_WORDS = [
    "active", "annual", "yearly", "premium", "loyal", "good", "excellent", "satisfied", "engaged",
]

# --- fixed values: bands (inclusive upper edge, label); None is the open last band --------
TENURE_BANDS_SHORT = [(3, "0-3"), (6, "4-6"), (9, "7-9"), (12, "10-12"), (None, "12+")]
TENURE_BANDS_MIDDLE = [
    (6, "0-6"), (12, "7-12"), (18, "13-18"), (24, "19-24"), (36, "25-36"), (None, "36+"),
]
TENURE_BANDS_LONG = [
    (6, "0-6"), (12, "7-12"), (24, "13-24"), (36, "25-36"), (48, "37-48"), (60, "49-60"),
    (None, "60+"),
]
TENURE_BANDS_DASHBOARD = [
    (6, "0–6 months"), (12, "7–12 months"), (24, "13–24 months"), (36, "25–36 months"),
    (60, "37–60 months"), (None, "60+ months"),
]
CHARGE_BANDS = ["Low", "Medium", "High", "Very High"]

# --- fixed values: weights and cut-offs of the scoring rules --------------------------------
BEHAVIOR_BASE = 0.45
BEHAVIOR_WEIGHTS = {"recency": 0.25, "usage": 0.15, "tenure": 0.10, "support": 0.15, "payment": 0.20}
BEHAVIOR_REVERSED = ["usage", "tenure"]
UNIVERSAL_WEIGHTS = {
    "tenure": 1.5, "usage": 1.5, "engagement": 2.0, "support": 1.5, "monthly_value": 0.75,
    "discount": 0.5, "contract": 1.5, "payment": 0.5,
}
UNIVERSAL_REVERSED = ["tenure", "usage", "engagement"]
UNIVERSAL_TEXT = ["contract", "payment"]

# --- fixed values: actions as (priority, action, recommendation) ---------------------------
ACTIONS = {
    "critical_monthly": (
        "Immediate",
        "Offer a personalized contract upgrade or retention incentive.",
        "Immediate intervention with a targeted retention offer.",
    ),
    "critical": (
        "Immediate",
        "Contact customer immediately with a personalized retention offer.",
        "High-touch retention intervention is recommended.",
    ),
    "high_payment": (
        "High",
        "Review payment experience and offer an easier payment option.",
        "Improve payment convenience and provide targeted engagement.",
    ),
    "high_early": (
        "High",
        "Launch an early-tenure onboarding and engagement campaign.",
        "Strengthen onboarding to prevent early customer churn.",
    ),
    "high": (
        "High",
        "Provide personalized service outreach and retention incentives.",
        "Proactive customer engagement is recommended.",
    ),
    "medium_growth": (
        "Monitor",
        "Introduce relevant upgrades and personalized offers.",
        "Use engagement and cross-sell opportunities to strengthen loyalty.",
    ),
    "medium": (
        "Monitor",
        "Monitor behavior and provide proactive customer engagement.",
        "Customer should remain under regular retention monitoring.",
    ),
    "low_loyal": (
        "Low",
        "Maintain service quality and reward customer loyalty.",
        "Focus on loyalty, advocacy and long-term value.",
    ),
    "low": (
        "Low",
        "Maintain engagement and monitor future churn signals.",
        "Continue standard customer engagement.",
    ),
}
CHANNELS = {
    "Immediate": "Personal Outreach", "High": "Targeted Campaign", "Monitor": "Email / In-App",
}
OTHER_CHANNEL = "Standard Engagement"
PRIORITY_ORDER = ["Immediate", "High", "Monitor", "Low"]

# --- fixed values: sentences (printf form) --------------------------------------------------
EXECUTIVE_INSIGHTS = {
    "mean": "Average churn probability is %.1f%% across %,d customers.",
    "high": "%,d customers have a churn probability of 70%% or higher and should receive "
            "priority retention attention.",
    "rate": "%.1f%% of customers are currently predicted to churn.",
    "risk": "%,d customers are classified as high or critical risk.",
    "contract": "%s customers show the highest contract-level churn rate at %.1f%%.",
    "tenure": "Average customer tenure is %.1f months.",
    "charge": "Average monthly customer charge is %,.2f.",
}
EDA_INSIGHTS = {
    "none": "A recognizable churn target was not detected.",
    "high": "Overall churn is high at %.1f%%. Retention should be treated as a major business priority.",
    "middle": "Overall churn is %.1f%%, indicating a meaningful retention opportunity.",
    "low": "Overall churn is relatively contained at %.1f%%.",
    "contract": "The highest observed churn rate is %.1f%% for %s.",
    "tenure": "The tenure group with the highest churn rate is %s at %.1f%%.",
}
EXECUTIVE_RECOMMENDATIONS = {
    "critical": "Prioritize immediate outreach to %,d critical-risk customers.",
    "high": "Launch targeted retention campaigns for %,d high-risk customers.",
    "revenue": "Focus retention resources on the estimated %,.2f monthly revenue at risk.",
    "elevated": "Overall churn probability is elevated; increase proactive customer engagement.",
    "active": "Maintain active churn monitoring and segment customers by behavioral risk.",
    "calm": "Overall churn risk is relatively controlled; focus on loyalty and customer-value expansion.",
}
READINESS = {
    "target": "Churn/Attrition target column",
    "no_id": "No customer ID column was detected. Customer-level identification may be limited.",
    "no_feature": "No common customer behavior or billing features were detected.",
    "missing": "The dataset contains more than 30% missing values.",
    "duplicates": "%d duplicate rows detected.",
}
MODE_ADAPTIVE = "Adaptive ML Model"
MODE_BEHAVIOR = "Behavioral Risk Engine"
MODE_SAVED = "Existing ML Model"
MODE_UNIVERSAL = "Universal Customer Risk Engine"

# --- fixed values: model-metrics table -------------------------------------------------------
METRIC_ALIASES = {
    "model": ["Model", "Algorithm", "Classifier", "Model Name"],
    "accuracy": ["Accuracy"],
    "precision": ["Precision"],
    "recall": ["Recall"],
    "f1_score": ["F1 Score", "F1"],
    "roc_auc": ["ROC-AUC", "AUC"],
}
METRIC_ORDER_DASHBOARD = ["roc_auc", "f1_score", "accuracy", "recall", "precision"]
METRIC_ORDER_TRAINING = ["f1_score", "roc_auc", "recall", "accuracy"]
INDEX_COLUMNS = ["unnamed0", "index", "rowindex", "rownumber"]
IDENTIFIER_KEYWORDS = ["customerid", "clientid", "accountid", "accountnumber", "customerkey"]
