"""Names, labels and thresholds that results depend on."""

# fixed values: columns that mark transaction-level input
TRANSACTION_MARKERS = ["total_amount", "quantity", "unit_price", "stock_code", "invoice"]

# fixed values: columns that customer-level input must have
CUSTOMER_REQUIRED = [
    "customer_id",
    "total_purchases",
    "avg_order_value",
    "days_since_first_purchase",
    "days_since_last_purchase",
]

# fixed values: columns that validation requires
VALIDATED_COLUMNS = [
    "customer_id",
    "age",
    "total_purchases",
    "avg_order_value",
    "days_since_first_purchase",
    "days_since_last_purchase",
    "acquisition_channel",
    "location",
    "subscription_status",
]

# fixed values: accepted header -> canonical header
COLUMN_ALIASES = {
    "customerid": "customer_id",
    "clientid": "customer_id",
    "cust_id": "customer_id",
    "total_transactions": "total_purchases",
    "transaction_count": "total_purchases",
    "purchase_count": "total_purchases",
    "avg_spend": "avg_order_value",
    "average_spend": "avg_order_value",
    "avg_transaction_value": "avg_order_value",
    "customer_age_days": "days_since_first_purchase",
    "first_purchase_days": "days_since_first_purchase",
    "recency_days": "days_since_last_purchase",
    "last_purchase_days": "days_since_last_purchase",
    "days_since_first": "days_since_first_purchase",
    "days_since_last": "days_since_last_purchase",
    "invoicedate": "invoice_date",
    "transactiondate": "invoice_date",
    "date": "invoice_date",
    "channel": "acquisition_channel",
    "source": "acquisition_channel",
    "region": "location",
    "sub_status": "subscription_status",
}

# fixed values: optional customer columns and their defaults
OPTIONAL_DEFAULTS = {
    "age": 35,
    "acquisition_channel": "Unknown",
    "location": "Unknown",
    "subscription_status": "None",
}

# fixed values: retail columns that transaction cleaning needs
RETAIL_REQUIRED = ["customer_id", "invoice_date", "quantity", "unit_price"]

# fixed values: retail headers without blanks, underscores and case -> canonical header
RETAIL_SPELLINGS = {
    "customerid": "customer_id",
    "invoicedate": "invoice_date",
    "quantity": "quantity",
    "unitprice": "unit_price",
    "price": "unit_price",
    "invoice": "invoice",
    "invoiceno": "invoice",
    "invoicenumber": "invoice",
    "stockcode": "stock_code",
    "description": "description",
    "country": "country",
}

# fixed values: words that a longer retail header must have -> canonical header
RETAIL_WORDS = {
    ("customer", "id"): "customer_id",
    ("invoice", "date"): "invoice_date",
    ("unit", "price"): "unit_price",
    ("invoice", "no"): "invoice",
    ("invoice", "number"): "invoice",
    ("stock", "code"): "stock_code",
    ("description",): "description",
}

# fixed values: largest amount kept, as a share of the amounts
OUTLIER_FRACTION = (999, 1000)

# fixed values: time split, in days
PREDICTION_DAYS = 6 * 30
LOOKBACK_DAYS = 12 * 30

# fixed values: month -> season
SEASONS = {
    "Winter": [12, 1, 2],
    "Spring": [3, 4, 5],
    "Summer": [6, 7, 8],
    "Fall": [9, 10, 11],
}

# fixed values: scores and labels, lowest value first
RFM_CLASSES = 5
SEGMENTS = ["Low Value", "Low-Medium", "Medium", "Medium-High", "High Value"]
TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
CHURN_MULTIPLIER = 2.0
BAND_WIDTH = 1.96
HIGH_RISK = 0.5
QUADRANT_RISK = 0.3
TOP_SHARE = 0.1

# fixed values: model inputs
TRANSACTION_FEATURES = [
    "total_transactions",
    "unique_invoices",
    "total_revenue",
    "avg_order_value",
    "std_order_value",
    "min_order_value",
    "max_order_value",
    "median_order_value",
    "total_quantity",
    "avg_quantity",
    "std_quantity",
    "unique_products",
    "avg_unit_price",
    "std_unit_price",
    "customer_lifespan",
    "days_since_last_purchase",
    "avg_days_between_purchases",
    "purchase_frequency",
    "purchase_velocity",
    "product_diversity_ratio",
    "spending_consistency",
    "revenue_per_transaction",
    "revenue_growth_potential",
    "years_active",
    "months_active",
    "quarters_active",
    "preferred_day_of_week",
    "preferred_hour",
    "weekend_purchase_rate",
    "recency_score",
    "frequency_score",
    "monetary_score",
    "churn_flag",
    "churn_probability",
    "season_encoded",
]
CUSTOMER_FEATURES = [
    "age",
    "total_purchases",
    "avg_order_value",
    "days_since_first_purchase",
    "days_since_last_purchase",
    "acquisition_channel",
    "location",
    "subscription_status",
]
CATEGORICAL_FEATURES = ["acquisition_channel", "location", "subscription_status"]

# fixed values: action lists per strategy
STRATEGY_ACTIONS = {
    "retain_and_grow": [
        "Premium loyalty programs",
        "Exclusive early access to new products",
        "Personalized VIP customer service",
        "Cross-selling and upselling opportunities",
        "Referral program incentives",
    ],
    "retention_focus": [
        "Proactive customer outreach",
        "Personalized retention offers",
        "Customer satisfaction surveys",
        "Issue resolution prioritization",
        "Loyalty program enrollment",
    ],
    "growth_focus": [
        "Product education and training",
        "Bundle offers and promotions",
        "Usage optimization recommendations",
        "Feature adoption campaigns",
        "Cross-selling initiatives",
    ],
    "win_back_or_let_go": [
        "Targeted win-back campaigns",
        "Special reactivation offers",
        "Customer feedback collection",
        "Service improvement opportunities",
        "Consider reducing marketing spend",
    ],
}

LOG_KEEP = 1000
