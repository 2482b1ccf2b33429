"""Expected rows and word lists of the SQL twins, written out (nothing here is taken from the operators)."""

# module flavor standard_column source_column expected_type actual_type type_ok ready module_ready chosen_flavor; "-" is NULL.
READINESS = {
    "churn_customers": """
churn - Churn Churn string string yes yes yes -
churn - Tenure Tenure numeric numeric yes yes yes -
churn - MonthlyCharges MonthlyCharges numeric numeric yes yes yes -
segmentation demographic Age - numeric - - no no -
segmentation demographic Spending_Score - - - - no no -
segmentation demographic Profession - string - - no no -
segmentation rfm CustomerID customerID - numeric yes no no -
segmentation rfm InvoiceDate - - - - no no -
segmentation rfm TotalAmount - numeric - - no no -
sentiment - ReviewText - string - - no no -
geo - Location - string - - no no -
role revenue revenue MonthlyCharges - numeric yes yes yes -
role id id customerID - numeric yes yes yes -
role contract contract Contract - string yes yes yes -
role spend spend MonthlyCharges - numeric yes yes yes -
role review_text review_text - - - - no no -
role customer_text customer_text - - - - no no -
role location location - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric MonthlyCharges - numeric yes yes yes -
role value_target value_target TotalCharges - string yes yes yes -
""",
    "demographics": """
churn - Churn - string - - no no -
churn - Tenure - numeric - - no no -
churn - MonthlyCharges - numeric - - no no -
segmentation demographic Age Age numeric numeric yes yes yes demographic
segmentation demographic Spending_Score Spending_Score - string yes yes yes demographic
segmentation demographic Profession Profession string string yes yes yes demographic
segmentation rfm CustomerID CustomerID - numeric yes no yes demographic
segmentation rfm InvoiceDate - - - - no yes demographic
segmentation rfm TotalAmount Spending_Score numeric string no no yes demographic
sentiment - ReviewText - string - - no no -
geo - Location - string - - no no -
role revenue revenue - - - - no no -
role id id CustomerID - numeric yes yes yes -
role contract contract - - - - no no -
role spend spend Spending_Score - string yes yes yes -
role review_text review_text - - - - no no -
role customer_text customer_text - - - - no no -
role location location - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role value_target value_target - - - - no no -
""",
    "transactions": """
churn - Churn - string - - no no -
churn - Tenure - numeric - - no no -
churn - MonthlyCharges - numeric - - no no -
segmentation demographic Age - numeric - - no yes rfm
segmentation demographic Spending_Score - - - - no yes rfm
segmentation demographic Profession - string - - no yes rfm
segmentation rfm CustomerID CustomerID - numeric yes yes yes rfm
segmentation rfm InvoiceDate InvoiceDate - datetime yes yes yes rfm
segmentation rfm TotalAmount TotalAmount numeric numeric yes yes yes rfm
sentiment - ReviewText - string - - no no -
geo - Location - string - - no no -
role revenue revenue TotalAmount - numeric yes yes yes -
role id id CustomerID - numeric yes yes yes -
role contract contract - - - - no no -
role spend spend TotalAmount - numeric yes yes yes -
role review_text review_text - - - - no no -
role customer_text customer_text - - - - no no -
role location location - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric TotalAmount - numeric yes yes yes -
role value_target value_target - - - - no no -
""",
    "reviews": """
churn - Churn - string - - no no -
churn - Tenure - numeric - - no no -
churn - MonthlyCharges - numeric - - no no -
segmentation demographic Age - numeric - - no no -
segmentation demographic Spending_Score - - - - no no -
segmentation demographic Profession - string - - no no -
segmentation rfm CustomerID - - - - no no -
segmentation rfm InvoiceDate - - - - no no -
segmentation rfm TotalAmount - numeric - - no no -
sentiment - ReviewText ReviewID string numeric no no no -
geo - Location - string - - no no -
role revenue revenue - - - - no no -
role id id ReviewID - numeric yes yes yes -
role contract contract - - - - no no -
role spend spend - - - - no no -
role review_text review_text ReviewBody - string yes yes yes -
role customer_text customer_text ReviewID - numeric yes yes yes -
role location location - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role value_target value_target - - - - no no -
""",
    "routes": """
churn - Churn - string - - no no -
churn - Tenure - numeric - - no no -
churn - MonthlyCharges - numeric - - no no -
segmentation demographic Age - numeric - - no no -
segmentation demographic Spending_Score - - - - no no -
segmentation demographic Profession - string - - no no -
segmentation rfm CustomerID CustomerID - numeric yes no no -
segmentation rfm InvoiceDate - - - - no no -
segmentation rfm TotalAmount Amount numeric numeric yes no no -
sentiment - ReviewText - string - - no no -
geo - Location Route string string yes yes yes -
role revenue revenue Amount - numeric yes yes yes -
role id id TripID - numeric yes yes yes -
role contract contract - - - - no no -
role spend spend Amount - numeric yes yes yes -
role review_text review_text - - - - no no -
role customer_text customer_text - - - - no no -
role location location Route - string yes yes yes -
role map_metric map_metric - - - - no no -
role map_metric map_metric - - - - no no -
role map_metric map_metric Amount - numeric yes yes yes -
role value_target value_target Amount - numeric yes yes yes -
""",
}
# rule_set capability detected evidence_column.
CAPABILITIES = {
    "churn_customers": """
substring sentiment no -
substring geo no -
substring segmentation yes TotalCharges
substring churn yes Churn
exact churn yes Tenure
exact sentiment no -
exact geo no -
exact segmentation no -
""",
    "demographics": """
substring sentiment no -
substring geo no -
substring segmentation yes Spending_Score
substring churn no -
exact churn no -
exact sentiment no -
exact geo no -
exact segmentation no -
""",
    "transactions": """
substring sentiment no -
substring geo no -
substring segmentation yes TotalAmount
substring churn no -
exact churn no -
exact sentiment no -
exact geo no -
exact segmentation no -
""",
    "reviews": """
substring sentiment yes ReviewID
substring geo no -
substring segmentation no -
substring churn no -
exact churn no -
exact sentiment no -
exact geo no -
exact segmentation no -
""",
    "routes": """
substring sentiment yes OverallRating
substring geo yes Route
substring segmentation yes Amount
substring churn no -
exact churn no -
exact sentiment no -
exact geo no -
exact segmentation yes -
""",
}

# Negation words.
NEGATORS = """
aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither
never no none nope nor not nothing nowhere oughtnt shant shouldnt wasnt werent without wont wouldnt rarely
seldom despite
""".split()
# Intensity boosters.
BOOSTERS_UP = """
absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially
exceptionally extremely fabulously fully greatly highly hugely incredibly intensely majorly more most
particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably
unusually utterly very
""".split()
# Dampeners.
BOOSTERS_DOWN = """
almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta
""".split() + ["kind of", "sort of"]
EMOTICONS = """
:) :-) :( :-( :d :-d ;) ;-) :p :-p :o :-o :/ :-/ :| :-| :* :-* =) =( =d :] :[ xd d: <3 </3 ^_^
""".split()
# Phrases and emoticons of the test lexicon.
LEXICON_EXTRAS = {"of the": 1.5, "the and the": -2.5, "the and": 0.5, "de la": -1.0, "et de la": 2.0, "in the that": 1.0, ":)": 2.0, ":(": -1.9}
# The English stop words that come with Spark.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
