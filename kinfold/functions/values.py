"""Names, orders, labels, priors and run lengths the results depend on."""

# Relation kinds kept from the edge list.
RELATIONS = ("lender", "family", "friend")

# The eight exclusive lender types, in model order.
CATEGORIES = (
    "friend_lender_ij",
    "family_lender_ij",
    "friend_family_lender_ij",
    "stranger_lender_ij",
    "friend_lender_ij_lender_ji",
    "family_lender_ij_lender_ji",
    "friend_family_lender_ij_lender_ji",
    "lender_ij_lender_ji",
)
COMMON = "common"
N_CATEGORIES = len(CATEGORIES)

# Subsets of the types that are summed in reported figures.
INDEBTED = CATEGORIES[4:]
NOT_INDEBTED = CATEGORIES[:4]
INTIMATE = CATEGORIES[0:3] + CATEGORIES[4:7]

# Chart labels of the eight types (short, long).
CATEGORY_LABELS = {
    "friend_lender_ij": "Best Friend\n(Non-indebted)",
    "family_lender_ij": "Salient Kin\n(Non-indebted)",
    "friend_family_lender_ij": "B. Friend + S. Kin\n(Non-indebted)",
    "stranger_lender_ij": "Not B. Friend or S. Kin\n(Non-indebted)",
    "friend_lender_ij_lender_ji": "Best Friend\n(Indebted)",
    "family_lender_ij_lender_ji": "Salient Kin\n(Indebted)",
    "friend_family_lender_ij_lender_ji": "B. Friend + S. Kin\n(Indebted)",
    "lender_ij_lender_ji": "Not B. Friend or S. Kin\n(Indebted)",
}
CATEGORY_LABELS_LONG = {
    "friend_lender_ij": "Best Friend\n(Non-indebted)",
    "family_lender_ij": "Salient Kin\n(Non-indebted)",
    "friend_family_lender_ij": "Best Friend + Salient Kin\n(Non-indebted)",
    "stranger_lender_ij": "Not Best Friend or Salient Kin\n(Non-indebted)",
    "friend_lender_ij_lender_ji": "Best Friend\n(Indebted)",
    "family_lender_ij_lender_ji": "Salient Kin\n(Indebted)",
    "friend_family_lender_ij_lender_ji": "Best Friend + Salient Kin\n(Indebted)",
    "lender_ij_lender_ji": "Not Best Friend or Salient Kin\n(Indebted)",
}

# Model names, their stacked variants in order, and chart labels.
MODELS = ("Baseline", "Extended", "Sex")
STACKED_MODELS = ("Baseline", "Extended", "Sex (Female)", "Sex (Male)", "Sex (Common)")
MODEL_LABELS = {
    "Baseline": "Baseline Model",
    "Extended": "Extended Model",
    "Sex (Female)": "Sex-Specic Model (Female)",
    "Sex (Male)": "Sex-Specic Model (Male)",
}
PPC_MODEL_LABELS = {
    "Baseline": "Baseline\nModel\n",
    "Extended": "Extended\nModel\n",
    "Sex": "Sex-Specific\nModel\n",
}
COMPARISON_LABELS = {
    "Baseline": "Common Parameters",
    "Extended": "Village-Specific Parameters",
    "Sex": "Village- and Sex-Specific Parameters",
}

# Tokens the CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Run lengths, seed, interval mass, diagnostic gates, axis limits.
SEED = 20200127
CHAINS = 4
DRAWS = 3000
TUNE = 2000
HDI_PROB = 0.95
SUMMARY_HDI_PROB = 0.94
BAND_Z = 1.96
MAX_RHAT = 1.01
MIN_ESS = 1000
FRACTION_LIMITS = (0.0, 0.6)
CONCENTRATION_LIMITS = (0.0, 15.0)
FREQUENCY_LIMITS = (-2.0, 3000.0)

# Priors. hyper_alpha ~ LogNormal, hyper_lambda ~ Gamma(shape, rate).
ALPHA_MU, ALPHA_SIGMA = 1.0, 1.0
LAMBDA_SHAPE, LAMBDA_RATE = 2.0, 2.0
