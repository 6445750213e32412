"""Values that results depend on literally: word lists, cut-offs, patterns and texts.

They are fixed by the behaviour being matched and are kept together here so that no
operator carries its own copy.
"""

# Value domains.
SEGMENTS = ["VIP", "High Value", "Medium Value", "Low Value", "General"]
CHURN_RISKS = ["High Risk", "Medium Risk", "Low Risk"]
CHURN_RISK_NAMES = {"HIGH": "High Risk", "MEDIUM": "Medium Risk", "LOW": "Low Risk"}
OPEN_STATUSES = ["open", "pending"]
INTENTS = ["customer_info", "support_history", "product_recommendation", "churn_analysis", "general"]

# Cut-offs of segments on lifetime value, from the top. The strict ones are to be exceeded, the others reached.
SEGMENT_OVER = {"VIP": 10000, "High Value": 5000, "Medium Value": 1000}
SEGMENT_FROM = {"VIP": 10000, "High Value": 5000, "Medium Value": 1000, "Low Value": 100}
VIP_ORDERS = 10

# Cut-offs of the churn risk, in days since the last order and open tickets by policy.
HIGH_RISK_DAYS, MEDIUM_RISK_DAYS = 180, 90
HIGH_RISK_TICKETS = {"simple": 0, "rfm_and": 1, "rfm_or": 2}

# Parts of the health scores. Pairs are an upper bound (days below it, tickets up to it) and its score.
RECENCY_SCORES, RECENCY_REST, RECENCY_MISSING = [(30, 100), (90, 75), (180, 50)], 25, 50
SUPPORT_SCORES, SUPPORT_REST = [(0, 100), (2, 70)], 30
SATISFACTION_MISSING = 50
HEALTH_WEIGHTS = {"recency": 0.25, "frequency": 0.20, "monetary": 0.25, "satisfaction": 0.15, "support": 0.15}
IMPROVING_FROM, DECLINING_BELOW = 80, 60
RISK_CUTS = {"days": 90, "tickets": 2, "satisfaction": 3.5}
POSITIVE_CUTS = {"value": 10000, "orders": 20, "satisfaction": 4.5}
# Deductions from one hundred, largest first, for a risk that names the word or for more than so many days or tickets.
RISK_DEDUCTIONS = [("HIGH", 30), ("MEDIUM", 15)]
DAYS_DEDUCTIONS = [(90, 20), (60, 10)]
TICKET_DEDUCTIONS = [(3, 15), (0, 5)]
VALUE_BONUS = (5000, 10)
# Additions to the churn probability: more than so many days or tickets, a satisfaction below.
CHURN_DAYS = [(180, 0.4), (90, 0.2)]
CHURN_TICKETS = [(3, 0.3), (1, 0.15)]
CHURN_SATISFACTION = [(3.0, 0.3), (3.5, 0.15)]

# Labels of the lines that documents are embedded and quoted by.
TICKET_LABELS = ["Subject: ", "Description: ", "Status: ", "Priority: "]
PRODUCT_LABELS = ["Product: ", "\nCategory: ", "\nDescription: ", "\nPrice: $"]
PRODUCT_CATEGORY = "General"
INTERACTION_LABELS = ["Interaction ID: ", "Customer: ", "Channel: ", "Sentiment: ", "Date: ", "Content: "]
SENTIMENT_SUMMARY = ["Customer ", " Sentiment Analysis:\nSummary: ", "\nLatest Average Score: "]
SOURCE_MARKS = ["--- SOURCE ", " ---\n", "\n--- END SOURCE ", " ---\n"]

# Labels of the customer profile in prompts, in the long and in the short form.
PROFILE_HEADING, BUDGETED_HEADING = "\nCUSTOMER PROFILE:\n", "\nCustomer Context:\n"
PROFILE_LABELS = [
    "Name", "Email", "Customer ID", "Segment", "Lifetime Value", "Total Orders", "Average Order Value", "Days Since Last Purchase",
    "Total Support Tickets", "Open Support Tickets", "Satisfaction Score", "Churn Risk", "Health Score", "Customer Since",
]
BUDGETED_LABELS = [
    "Name", "Email", "Segment", "Lifetime Value", "Total Orders", "Days Since Last Purchase", "Open Support Tickets", "Satisfaction Score", "Churn Risk",
]

# Intent words, tried in this order; the last row needs a known customer.
INTENT_WORDS = [
    ("product_recommendation", ["product", "recommend", "suggest", "buy", "purchase"]),
    ("support_history", ["ticket", "support", "issue", "problem", "complaint"]),
    ("churn_analysis", ["churn", "risk", "leave", "retention", "cancel"]),
]
CUSTOMER_INFO_WORDS = ["who", "what", "profile", "information", "detail"]

# How many hits each intent takes from each corpus.
TICKETS_PER_INTENT = {"support_history": 5, "product_recommendation": 0, "churn_analysis": 3, "customer_info": 3, "general": 3}
PRODUCTS_PER_INTENT = {"support_history": 0, "product_recommendation": 5, "churn_analysis": 0, "customer_info": 2, "general": 2}
MAX_SOURCES = 5
SIMILARITY_THRESHOLD = 0.7
EMBEDDING_DIMENSION = 768
TICKET_LISTS = 100
PRODUCT_LISTS = 50

# Words that never count as keywords, and the punctuation cut off words.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "can", "this", "that", "these",
    "those", "i", "you", "he", "she", "it", "we", "they", "my", "your",
]
WORD_PUNCTUATION = ".,!?;:()\"'"

# Patterns. An address matches from its start; nothing anchors its end.
# Chunks end at one of these signs if one lies within so many characters of their full size.
SENTENCE_SIGNS = ".?!"
SENTENCE_REACH = 200
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CITATION_PATTERN = r"\[Source (\d+)\]"

# Upstream tables that feed the lake and how often (minutes).
LANDED_TABLES = {
    "salesforce": (15, ["Account", "Contact", "Opportunity", "Case", "User"]),
    "zendesk": (15, ["tickets", "ticket_comments", "users", "organizations", "satisfaction_ratings"]),
    "shopify": (15, ["customer", "order", "product", "abandoned_checkouts"]),
    "google_analytics_4": (60, []),
}

# Factor texts of the detailed health score.
RISK_FACTORS = [
    "No purchases in 90+ days",
    "Multiple open support tickets",
    "Low satisfaction score",
    "High churn risk identified",
]
POSITIVE_FACTORS = [
    "High lifetime value",
    "Frequent purchaser",
    "Highly satisfied customer",
    "VIP customer segment",
]

# Prompt texts.
PROMPT_INSTRUCTIONS = """You are an AI customer intelligence assistant for enterprise customer service.

Your role:
- Provide helpful, accurate insights about customers based on their data.
- Always ground your responses in the provided context.
- Cite your sources using [Source N] notation.
- If you don't have enough information, say so clearly.

Guidelines:
- Only use information from the provided context.
- Never make up or hallucinate data.
- Be concise but comprehensive.
- Focus on actionable insights.
"""

PROMPT_CLOSING = """
INSTRUCTIONS:
Provide a helpful, data-driven response to the user's query. Use the customer profile and historical data to inform your answer. Cite specific sources using [Source N] notation when referencing information.

If recommending actions, be specific and prioritize based on the customer's risk level and value.

RESPONSE:"""

BUDGETED_INSTRUCTIONS = """You are an AI customer intelligence assistant. Your role is to provide helpful, accurate, and personalized insights about customers based on their data.

Guidelines:
- Always ground your responses in the provided data
- Be empathetic and customer-focused
- Provide specific, actionable recommendations
- Cite your sources when making claims
- If you don't have enough information, say so
"""

BUDGETED_CLOSING = "\nProvide a helpful, data-driven response:"

# The preset questions.
PRESET_QUESTIONS = {
    "churn_risk": """Analyze this customer's churn risk in detail:
1. What are the key risk factors?
2. What is their engagement trend?
3. What specific actions should we take to retain them?
4. What is the urgency level?

Provide concrete, actionable recommendations.""",
    "recommend_products": """Recommend 5 products for this customer based on:
- Their purchase history and preferences
- Their customer segment and value
- Current trends in their category


For each recommendation, explain why it's a good fit.
Your final output MUST be a JSON array of recommendations.""",
    "support_history": """Summarize this customer's support history:
1. List their most recent support tickets with status
2. Identify any recurring themes or issues
3. Assess their overall satisfaction level
4. Recommend any proactive support actions

Be specific and reference actual ticket data.""",
    "executive_summary": """Provide a comprehensive executive summary of this customer:
1. Overall customer health and value
2. Recent activity and engagement
3. Key opportunities (upsell, cross-sell, retention)
4. Immediate action items
5. Risk factors to monitor

Keep it concise but actionable.""",
}
# What an answer says when the model fails, the preset whose answer is structured, and the comparison.
APOLOGY = "I apologize, but I encountered an error: "
RECOMMENDING = "recommend_products"
COMPARE_QUESTION = """Compare these two customers and identify:
1. Key similarities and differences
2. Which customer is more valuable and why
3. Which customer has higher churn risk
4. Different engagement strategies needed for each
"""

# Texts of the interaction analyst, with their layout.
ANALYST_OPENING = """
        You are an expert customer intelligence analyst. Use ONLY the 'RELEVANT CONTEXT' provided below to answer the user's 'QUERY'. 
        Cite the source number (e.g., [Source 1], [Source 2]) for every piece of factual information you state.

        RELEVANT CONTEXT:
        """
ANALYST_QUERY = """

        QUERY: """
ANALYST_CLOSING = """
        
        RESPONSE (Grounded in context, cite sources):
        """
# The interaction analyst's answer when the model fails, and the sentiment prompt.
INTERACTION_ERROR = "Error during RAG generation: "
SENTIMENT_OPENING = "Analyze the following recent sentiment data for customer "
SENTIMENT_CLOSING = (
    "Provide a concise summary of the sentiment trend (improving, declining, volatile) "
    "and highlight the average sentiment score over the period. The scores range from -1.0 (negative) to 1.0 (positive)."
)
