"""The text of the data profile report, rendered from the collected profile.

Input is small: one row per column, up to five top values per text column
and one row of facts. Section order and sentences follow the reference.
"""

from __future__ import annotations

from quarry.operators.profile import MISSING_NOTE_PCT

# --- fixed values: report headings and sentences of the reference ---------------------
TITLE = ["DATA SCIENCE ANALYSIS REPORT", "Comprehensive Dataset Evaluation and Insights", "", ""]
SUMMARY_HEAD = ["EXECUTIVE SUMMARY", ""]
SUMMARY = ("This dataset comprises {rows} observations across {cols} distinct variables. The overall "
           "data completeness stands at {pct} percent, with {populated} populated values out of {total} "
           "total possible data points. This level of completeness indicates {quality}.")
SUMMARY_QUALITY = [
    (95, "excellent data quality suitable for advanced modeling"),
    (80, "good data quality appropriate for most analytical tasks"),
    (60, "moderate data quality requiring some preprocessing"),
    (None, "limited data quality necessitating significant data cleaning"),
]
STRUCTURE_HEAD = ["DATASET STRUCTURE AND DIMENSIONALITY", ""]
STRUCTURE = ("The dataset contains {cols} variables: {names}. With {rows} observations and {cols} features, "
             "the data dimensionality is {dim}.")
DIMENSIONALITY = {
    "low": "low, which is favorable for most machine learning algorithms",
    "moderate": "moderate, suitable for various modeling approaches",
    "high": "relatively high, which may benefit from dimensionality reduction techniques such as PCA or "
            "feature selection methods",
}
VARIABLES_HEAD = ["DETAILED VARIABLE ANALYSIS", ""]
EMPTY_VARIABLE = ("This variable contains no populated values and requires data collection before analysis. "
                  "Missing data imputation or feature removal should be considered.")
NUMERIC_SUMMARY = ("Statistical Summary: This continuous variable exhibits a range from {min} (minimum) to {max} "
                   "(maximum), yielding a range of {range}. The central tendency measures include a mean of {mean} "
                   "and median of {median}. The standard deviation is {sd}, indicating {variability} in the data.")
VARIABILITY = {"high": "high variability", "moderate": "moderate variability", "low": "low variability"}
DISTRIBUTION = "Distribution Characteristics: The data exhibits {skew}. {note}"
SKEW = {"symmetric": "approximately symmetric distribution",
        "right": "right-skewed distribution (positive skew)",
        "left": "left-skewed distribution (negative skew)"}
DISTRIBUTION_NOTE = {
    "higher": "The mean being higher than the median suggests that extreme high values are pulling the average "
              "upward, which is common in positively skewed distributions.",
    "lower": "The mean being lower than the median indicates that extreme low values are pulling the average "
             "downward, typical of negatively skewed distributions.",
    "similar": "The similarity between mean and median suggests a relatively symmetric distribution around the "
               "central value.",
}
OUTLIERS = ("Outlier Detection: Using the Interquartile Range (IQR) method with Q1 at {q1} and Q3 at {q3}, we "
            "identified {n} outliers ({pct} percent of observations). These values fall outside the range of "
            "{lo} to {hi}. Consider outlier treatment methods such as Winsorization, transformation, or removal "
            "depending on whether these represent genuine extreme values or data errors.")
NUMERIC_MISSING = "Missing Data: {n} observations ({pct} percent) contain missing values for this variable. {advice}"
NUMERIC_MISSING_HIGH = ("This significant level of missingness may require imputation techniques such as "
                        "mean/median imputation, regression imputation, or multiple imputation methods. "
                        "Alternatively, consider using algorithms that handle missing values naturally, such as "
                        "XGBoost or LightGBM.")
NUMERIC_MISSING_LOW = ("This relatively low level of missingness can be addressed through simple imputation "
                       "methods or by using complete case analysis.")
NUMERIC_COMPLETE = "Data Completeness: This variable has no missing values, which is optimal for analysis."
CARDINALITY = ("Cardinality Analysis: This categorical variable contains {card} unique categories among {n} "
               "observations, resulting in a cardinality ratio of {pct} percent. {note}")
CARDINALITY_NOTE = {
    "identifier": "Each observation has a unique value, suggesting this may be an identifier rather than a "
                  "predictive feature. Consider removing this variable from modeling.",
    "high": "The high cardinality suggests this variable may benefit from grouping rare categories or using "
            "target encoding techniques.",
    "low": "The low cardinality makes this variable suitable for one-hot encoding in most machine learning "
           "algorithms.",
    "moderate": "The moderate cardinality may require careful encoding strategies such as target encoding, "
                "frequency encoding, or grouping rare categories.",
}
CATEGORY_DISTRIBUTION = "Category Distribution: The most frequent categories are {tops}. {note}"
CATEGORY_ITEM = '"{value}" ({count} occurrences, {pct} percent)'
CONCENTRATION = {
    "severe": "The high concentration in a single category indicates severe class imbalance, which may require "
              "resampling techniques or algorithm adjustments.",
    "moderate": "The moderate concentration in the dominant category suggests some imbalance that should be "
                "monitored during modeling.",
    "balanced": "The distribution shows reasonable balance across categories.",
}
CATEGORICAL_MISSING = ("Missing Data: {n} observations ({pct} percent) lack values for this categorical variable. "
                       "Consider treating missing values as a separate category, using mode imputation, or "
                       "applying more sophisticated techniques like KNN imputation if appropriate.")
QUALITY_HEAD = ["", "DATA QUALITY AND INTEGRITY ASSESSMENT", ""]
QUALITY_WORD = [(95, "excellent"), (80, "good"), (60, "moderate"), (None, "poor")]
QUALITY = "Overall Quality Metrics: The dataset exhibits {word} data quality with {pct} percent completeness across all variables. {dups}"
DUPLICATES = ("Duplicate analysis identified {n} duplicate observations ({pct} percent of the dataset). These "
              "duplicates should be investigated to determine if they represent legitimate repeated measurements "
              "or data collection errors. Consider using df.drop_duplicates() in Python or similar methods to "
              "remove exact duplicates after validation.")
NO_DUPLICATES = ("No duplicate observations were detected, which indicates strong data integrity and quality "
                 "control measures.")
SKEWNESS = ("Skewness Detected: The following variables exhibit distributional skewness: {cols}. For modeling "
            "purposes, consider applying transformations such as log transformation, square root transformation, "
            "or Box-Cox transformation to normalize these distributions. This is particularly important for "
            "linear models and algorithms that assume normally distributed features.")
OUTLIER_PRESENCE = ("Outlier Presence: Outliers were detected in {n} variable{s}: {cols}. Depending on your "
                    "analysis goals, consider strategies such as robust scaling (using RobustScaler), outlier "
                    "capping (Winsorization), or using tree-based algorithms that are naturally resistant to "
                    "outliers (Random Forest, XGBoost).")
ML_HEAD = ["", "MACHINE LEARNING AND MODELING RECOMMENDATIONS", "", "Recommended Preprocessing Steps:", ""]
ALGORITHMS_HEAD = ["", "Suitable Machine Learning Algorithms:", ""]
ADVICE_HEAD = ["", "ADDITIONAL DATA SCIENCE RECOMMENDATIONS", ""]
RULE_TEXT = {
    "impute_missing": "Handle missing values using appropriate imputation methods. For numeric variables, consider "
                      "mean/median imputation or more advanced techniques like KNN imputation or iterative "
                      "imputation (MICE). For categorical variables, mode imputation or treating missing as a "
                      "separate category may be appropriate.",
    "remove_duplicates": "Remove or investigate {dups} duplicate observations to ensure model training on unique "
                         "data points.",
    "transform_skewed": "Apply normalization transformations to skewed variables ({skewed}). Consider log "
                        "transformation for right-skewed data or power transformations for left-skewed data.",
    "treat_outliers": "Address outliers in {outliers} through capping, transformation, or by choosing robust "
                      "algorithms. For regression tasks, consider using Huber loss or quantile regression.",
    "scale_numeric": "Scale numeric features using StandardScaler for algorithms sensitive to feature scales (SVM, "
                     "Neural Networks, K-Nearest Neighbors) or RobustScaler if outliers are present.",
    "encode_categorical": "Encode categorical variables appropriately. Use one-hot encoding for low cardinality "
                          "features (less than 10 categories), target encoding or frequency encoding for high "
                          "cardinality features, and consider ordinal encoding if there is a natural order.",
    "deep_learning": "Deep Learning approaches (Neural Networks, Deep Neural Networks) are viable given the "
                     "substantial sample size of {rows} observations and {n_numeric} numeric features. Consider "
                     "using frameworks like TensorFlow or PyTorch.",
    "gradient_boosting": "Gradient Boosting algorithms (XGBoost, LightGBM, CatBoost) are highly recommended as they "
                         "handle mixed data types effectively, are robust to outliers and missing values, and "
                         "typically provide excellent predictive performance. CatBoost is particularly suitable "
                         "given the presence of categorical variables as it handles them natively.",
    "random_forest": "Random Forest and other ensemble methods are excellent choices, offering good performance, "
                     "feature importance insights, and resistance to overfitting through bagging. They work well "
                     "with the current sample size and handle non-linear relationships effectively.",
    "linear_models": "Linear models (Linear Regression, Logistic Regression, Lasso, Ridge) are appropriate if "
                     "interpretability is important. They perform best when features are normalized and outliers "
                     "are addressed. Consider regularization (L1/L2) to prevent overfitting.",
    "support_vector_machines": "Support Vector Machines (SVM) with RBF kernel can capture complex non-linear "
                               "patterns, though they require feature scaling and are computationally intensive "
                               "for large datasets. Consider using for datasets under 10,000 observations.",
    "decision_trees": "Decision Trees and Rule-based models are interpretable options that handle categorical data "
                      "naturally without requiring encoding, though they may be prone to overfitting without "
                      "proper regularization.",
    "correlation_analysis": "Perform correlation analysis and create a correlation matrix to identify "
                            "multicollinearity among numeric features. High correlation (above 0.9) may "
                            "necessitate feature selection or dimensionality reduction techniques like PCA.",
    "cross_validation": "Implement cross-validation strategies (k-fold cross-validation with k equals 5 or 10) to "
                        "ensure robust model evaluation and prevent overfitting. For time-series data, use "
                        "time-series cross-validation.",
    "interaction_features": "Conduct feature engineering to create interaction terms between categorical and "
                            "numeric variables, which may capture non-linear relationships and improve model "
                            "performance.",
    "exploratory_plots": "Perform exploratory data analysis with visualization techniques (histograms, box plots, "
                         "Q-Q plots) to better understand distributions and guide preprocessing decisions.",
    "stratified_split": "Split data into training, validation, and test sets using stratified sampling if dealing "
                        "with classification problems. A common split is 70 percent training, 15 percent "
                        "validation, and 15 percent test.",
    "missing_patterns": "Analyze missing data patterns using missingness heatmaps or correlation analysis. If data "
                        "is Missing Not At Random (MNAR), consider specialized handling techniques or collecting "
                        "additional data.",
    "feature_selection": "Consider feature selection techniques such as Recursive Feature Elimination (RFE), L1 "
                         "regularization, or tree-based feature importance to identify the most predictive "
                         "variables and reduce model complexity.",
    "hyperparameter_tuning": "Implement hyperparameter tuning using Grid Search or Randomized Search with "
                             "cross-validation to optimize model performance. For computationally expensive "
                             "models, consider Bayesian optimization.",
    "baseline_models": "Establish baseline models (simple heuristics or basic algorithms) before implementing "
                       "complex models to ensure that added complexity provides meaningful performance gains.",
}
CONCLUSION_HEAD = ["", "CONCLUSION", ""]
CONCLUSION = ("This dataset comprising {rows} observations across {cols} variables presents {found} foundations "
              "for machine learning and statistical analysis. The dataset contains {n_num} numeric {num_word} and "
              "{n_cat} categorical {cat_word}, providing {space} feature space for modeling. {outl}{skew}By "
              "following the preprocessing recommendations and selecting appropriate algorithms based on the data "
              "characteristics outlined in this report, data scientists can develop robust predictive models and "
              "extract meaningful insights to drive data-driven decision-making.")
CONCLUSION_FOUNDATION = [(90, "strong"), (70, "adequate"), (None, "developing")]
CONCLUSION_OUTLIERS = "Attention should be given to outlier treatment in {n} variable{s}, and "
CONCLUSION_SKEW = "distribution normalization for {n} skewed variable{s}. "
# ----------------------------------------------------------------------------------------


def _band(x, bands):
    for bound, word in bands:
        if bound is None or (x is not None and x >= bound):
            return word
    return bands[-1][1]


def render_lines(rows, headers, cols, tops, fact, fired, locale, to_fixed):
    """Lines ``(section, text)`` of the report, in order."""
    out: list[tuple[str, str]] = []

    def put(section, *lines):
        out.extend((section, ln) for ln in lines)

    ncols = len(headers)
    total = rows * ncols
    empty = sum(c["rows"] - c["populated"] for c in cols)
    comp = (total - empty) / total * 100 if total else float("nan")
    pct = to_fixed(comp, 1)
    put("title", *TITLE)
    put("summary", *SUMMARY_HEAD)
    put("summary", SUMMARY.format(rows=locale(rows), cols=ncols, pct=pct, populated=locale(total - empty),
                                  total=locale(total), quality=_band(comp, SUMMARY_QUALITY)), "", "")
    ratio = ncols / rows if rows else float("inf")
    dim = "low" if ratio < 0.01 else "moderate" if ratio < 0.1 else "high"
    put("structure", *STRUCTURE_HEAD)
    put("structure", STRUCTURE.format(cols=ncols, names=", ".join(headers), rows=locale(rows),
                                      dim=DIMENSIONALITY[dim]), "", "")
    put("variables", *VARIABLES_HEAD)
    skewed, outl, numeric, categorical = [], [], [], []
    for c in cols:
        name = c["column_name"]
        if c["kind"] == "empty":
            put("variables", f"Variable: {name}", EMPTY_VARIABLE, "")
            continue
        missing = c["rows"] - c["populated"]
        mpct = to_fixed(missing / c["rows"] * 100, 1)
        if c["kind"] == "numeric":
            numeric.append(name)
            if c["outliers"]:
                outl.append(name)
            if c["skew"] in ("right", "left"):
                skewed.append(f"{name} ({c['skew']}-skewed)")
            l2 = lambda x: locale(x, 2)
            put("variables", f"Variable: {name} (Numeric)",
                NUMERIC_SUMMARY.format(min=l2(c["min"]), max=l2(c["max"]), range=l2(c["range"]),
                                       mean=l2(c["mean"]), median=l2(c["median"]), sd=l2(c["sd"]),
                                       variability=VARIABILITY[c["variability"]]), "",
                DISTRIBUTION.format(skew=SKEW[c["skew"]], note=DISTRIBUTION_NOTE[c["distribution"]]), "")
            if c["outliers"]:
                put("variables", OUTLIERS.format(
                    q1=l2(c["q1"]), q3=l2(c["q3"]), n=locale(c["outliers"]),
                    pct=to_fixed(c["outliers"] / c["numeric_n"] * 100, 1),
                    lo=l2(c["lower_fence"]), hi=l2(c["upper_fence"])), "")
            if missing > 0:
                advice = NUMERIC_MISSING_HIGH if float(mpct) > MISSING_NOTE_PCT else NUMERIC_MISSING_LOW
                put("variables", NUMERIC_MISSING.format(n=locale(missing), pct=mpct, advice=advice), "")
            else:
                put("variables", NUMERIC_COMPLETE, "")
        else:
            if c["kind"] == "categorical":
                categorical.append(name)
            n, card = c["populated"], c["distinct_n"]
            put("variables", f"Variable: {name} (Categorical)",
                CARDINALITY.format(card=locale(card), n=locale(n), pct=to_fixed(card / n * 100, 1),
                                   note=CARDINALITY_NOTE[c["cardinality"]]), "")
            top = tops.get(c["position"], [])
            if top:
                items = ", ".join(CATEGORY_ITEM.format(value=v, count=locale(k), pct=to_fixed(k / n * 100, 1))
                                  for v, k in top)
                put("variables", CATEGORY_DISTRIBUTION.format(tops=items, note=CONCENTRATION[c["concentration"]]), "")
            if missing > 0:
                put("variables", CATEGORICAL_MISSING.format(n=locale(missing), pct=mpct), "")
    dups = fact["duplicates"]
    put("quality", *QUALITY_HEAD)
    dup_text = (DUPLICATES.format(n=locale(dups), pct=to_fixed(dups / rows * 100, 1)) if dups > 0
                else NO_DUPLICATES)
    put("quality", QUALITY.format(word=_band(comp, QUALITY_WORD), pct=pct, dups=dup_text), "")
    if skewed:
        put("quality", SKEWNESS.format(cols=", ".join(skewed)), "")
    if outl:
        put("quality", OUTLIER_PRESENCE.format(n=len(outl), s="s" if len(outl) > 1 else "",
                                               cols=", ".join(outl)), "")
    values = dict(dups=locale(dups), skewed=", ".join(skewed), outliers=", ".join(outl), rows=locale(rows),
                  n_numeric=len(numeric))
    for group, head in (("preprocessing", ML_HEAD), ("algorithm", ALGORITHMS_HEAD), ("advice", ADVICE_HEAD)):
        put(group, *head)
        for i, rid in enumerate(fired[group]):
            put(group, f"{i + 1}. {RULE_TEXT[rid].format(**values)}", "")
    put("conclusion", *CONCLUSION_HEAD)
    put("conclusion", CONCLUSION.format(
        rows=locale(rows), cols=ncols, found=_band(comp, CONCLUSION_FOUNDATION),
        n_num=len(numeric), num_word="variable" if len(numeric) == 1 else "variables",
        n_cat=len(categorical), cat_word="variable" if len(categorical) == 1 else "variables",
        space="rich" if len(numeric) + len(categorical) >= 10 else "sufficient",
        outl=CONCLUSION_OUTLIERS.format(n=len(outl), s="s" if len(outl) > 1 else "") if outl else "",
        skew=CONCLUSION_SKEW.format(n=len(skewed), s="s" if len(skewed) > 1 else "") if skewed else ""))
    return out
