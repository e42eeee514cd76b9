"""SURVEY section 2 operator id -> (operator function, registered queries).

``tests/test_coverage.py`` checks that every id of the inventory is listed
here and that every listed query is registered.  An empty query list
marks an operator that is not built (see README)."""

COVERAGE = {
    # 2.1 sources and sinks
    "IO1": ("sources.io.read_transactions", ["io_csv_roundtrip_failure_rate"]),
    "IO2": ("sources.io.read_with_fallback", ["io_read_with_fallback"]),
    "IO3": ("sources.io.write_table", ["io_csv_roundtrip_failure_rate", "io_read_feedback_files"]),
    "IO4": ("sources.io.write_batches", ["io_write_batches"]),
    "IO5": ("sources.io.read_feedback", ["io_read_feedback_files"]),
    "IO6": ("streaming.streams.file_stream(archive_dir=...)", ["stream_feedback_archive"]),
    "IO7": ("sources.io.export_features", ["io_export_features"]),
    "IO8": ("sources.io.write_report", ["io_write_report"]),
    "IO9": ("operators.ml.save_model", ["ml_retrain_and_score"]),
    "IO10": ("operators.ml.load_model", ["ml_retrain_and_score"]),
    "IO11": ("sources.io.parse_requests", ["io_parse_requests"]),
    # 2.2 profiling and cleaning
    "PR1": ("operators.clean.shape_types", ["shape"]),
    "PR2": ("operators.clean.missing_profile", ["missing_profile"]),
    "PR3": ("operators.clean.missing_patterns", ["missing_patterns"]),
    "PR4": ("operators.clean.describe_numeric / windows.exact_quantiles", ["describe_numeric", "exact_quantiles_latency",
                                                                         "exact_quantiles_amount_by_method"]),
    "PR5": ("operators.clean.duplicate_count", ["duplicate_count"]),
    "PR6": ("operators.clean.label_distribution", ["label_distribution"]),
    "CL1": ("operators.clean.fill_sentinels", ["fill_sentinels"]),
    "CL2": ("operators.clean.fill_median", ["fill_median_latency"]),
    "CL3": ("operators.clean.impute", ["impute_mean_latency", "impute_most_frequent_error", "impute_zero_latency"]),
    "CL4": ("operators.clean.outliers_iqr / flag_outliers", ["outliers_iqr_amount"]),
    "CL5": ("operators.clean.outliers_zscore / flag_outliers", ["outliers_zscore_amount"]),
    "CL6": ("operators.clean.outlier_report", ["outlier_report"]),
    "CL7": ("operators.clean.cap_outliers", ["cap_outliers_amount", "winsorize_amount"]),
    "CL8": ("operators.clean.standardize_text", ["standardize_text"]),
    "CL9": ("operators.clean.parse_timestamps", ["parse_ts"]),
    "CL10": ("operators.clean.box_stats", ["box_stats_amount_by_method"]),
    "CL11": ("operators.clean.histogram", ["histogram_amount_by_result"]),
    "CL12": ("operators.clean.kde", ["kde_amount"]),
    # 2.3 projections, filters, scalar functions
    "SC1": ("operators.features.add_time_parts", ["time_features"]),
    "SC2": ("functions.expr.is_weekend", ["time_features"]),
    "SC3": ("functions.expr.time_of_day", ["time_features"]),
    "SC4": ("functions.expr.hhmm / format_ts", ["time_features"]),
    "SC5": ("functions.expr.is_failure / is_success", ["scalar_features"]),
    "SC6": ("functions.expr.digits_of_id", ["scalar_features"]),
    "SC7": ("functions.expr.make_id", ["scalar_features"]),
    "SC8": ("functions.expr.log1p", ["scalar_features"]),
    "SC9": ("functions.expr.amount_bin_fixed", ["amount_bins_fixed_open", "failure_rate_by_amount_bin"]),
    "SC10": ("functions.expr.amount_bin_open", ["amount_bins_fixed_open", "success_rate_by_amount_bin_open"]),
    "SC11": ("operators.features.qbin", ["quantile_bins"]),
    "SC12": ("functions.expr.ordinal", ["quantile_bins"]),
    "SC13": ("functions.expr.has_retry", ["scalar_features"]),
    "SC14": ("functions.expr.clip01", ["scalar_features"]),
    "SC15": ("operators.reports.with_failure_reason", ["failed_with_error_text"]),
    "SC16": ("operators.features.filter_dashboard", ["filter_dashboard_default", "filter_dashboard_range"]),
    "SC17": ("operators.features.filter_summary", ["filter_summary"]),
    "SC18": ("where(result = failure)", ["failed_with_error_text"]),
    "SC19": ("operators.features.display_rows", ["display_rows"]),
    "SC21": ("functions.expr.action", ["scalar_features"]),
    "SC22": ("operators.features.minmax", ["minmax_scaled"]),
    "SC23": ("operators.features.standardize", ["standardized"]),
    "SC24": ("operators.features.robust_scale", ["robust_scaled"]),
    "SC25": ("operators.features.one_hot", ["one_hot_method"]),
    "SC26": ("operators.features.label_encode / target_encode", ["label_encode_device", "target_encode_merchant"]),
    "SC27": ("operators.clean.columns_by_type", ["columns_by_type"]),
    "SC28": ("DataFrame.withColumnsRenamed", ["renamed_columns"]),
    "SC29": ("operators.features.date_spine", ["date_spine_daily"]),
    "SC30": ("functions.expr.is_business_hours", ["time_features"]),
    "SC31": ("functions.expr.peak_band", ["time_features"]),
    # 2.4 joins and set operations
    "JN1": ("operators.features.attach_group_stats", ["group_stats"]),
    "JN2": ("operators.reports.join_counts", ["success_rate_by_payment_method", "success_rate_by_device"]),
    "JN3": ("operators.reports.semi_top_merchants", ["semi_top_merchants"]),
    "JN4": ("operators.features.is_peak_hour", ["is_peak_hour"]),
    "JN5": ("operators.intervals.interval_join", ["tag_event", "incident_exposure"]),
    "JN6": ("operators.features.event_factor", ["event_factor"]),
    "JN7": ("operators.features.lookup_dims", ["lookup_dims"]),
    "JN8": ("operators.features.compare_decisions", ["compare_decisions_simple_vs_actual"]),
    "JN9": ("operators.features.prediction_vs_actual", ["prediction_vs_actual", "prediction_vs_actual_bucketed"]),
    "ST1": ("operators.reports.union_files", ["union_training_feedback"]),
    "ST2": ("operators.reports.feature_intersection_or_union", ["ml_select_features"]),
    "ST3": ("operators.reports.distinct_values", ["distinct_methods"]),
    "ST4": ("operators.reports.rows_without", ["rows_without_label"]),
    # 2.5 aggregations
    "AG1": ("operators.reports.failure_rate_by", [
        "failure_rate_by_payment_method", "failure_rate_by_processor", "failure_rate_by_location",
        "failure_rate_by_hour", "failure_rate_by_day", "failure_rate_by_amount_bin", "failure_rate_by_date",
        "failure_rate_by_merchant", "failure_rate_by_method_merchant", "failure_rate_by_method_hour",
        "failure_rate_by_method_amount_bin", "sales_failure_rate_by_priority_region"]),
    "AG2": ("operators.reports.success_rate_by", [
        "success_rate_by_payment_method", "success_rate_by_device", "success_rate_by_amount_bin_open",
        "success_rate_by_hour", "success_rate_by_day", "success_rate_by_location", "success_rate_by_location_device",
        "success_rate_by_date", "success_rate_by_retry_count"]),
    "AG3": ("operators.reports.kpis", ["kpis"]),
    "AG4": ("operators.reports.error_table", ["error_table"]),
    "AG5": ("operators.reports.error_share_by_method", ["error_share_by_method"]),
    "AG6": ("operators.reports.contingency", ["contingency_method_result"]),
    "AG7": ("operators.reports.heatmap_pivot", ["heatmap_day_hour", "heatmap_method_hour"]),
    "AG8": ("operators.reports.error_share_by_processor", ["error_share_by_processor"]),
    "AG9": ("operators.reports.processor_scorecard", ["processor_scorecard"]),
    "AG10": ("operators.reports.slot_profile", ["slot_profile"]),
    "AG11": ("operators.reports.group_mean_count", ["group_mean_count_processor", "group_mean_count_method"]),
    "AG12": ("operators.reports.merchant_volume_top", ["merchant_volume_top", "sales_merchant_volume_top"]),
    "AG13": ("operators.reports.merchant_lowest", ["merchant_lowest"]),
    "AG14": ("operators.reports.mix_counts", ["mix_location_method", "mix_merchant_method"]),
    "AG15": ("operators.reports.daily_avg_count", ["daily_avg_count"]),
    "AG16": ("operators.reports.class_weights", ["class_weights"]),
    "AG17": ("operators.reports.corr_long", ["corr_matrix"]),
    "AG18": ("operators.reports.high_corr_pairs", ["high_corr_pairs"]),
    "AG19": ("operators.reports.corr_with_target", ["corr_with_target"]),
    "AG20": ("operators.reports.latency_percentiles", ["latency_percentiles"]),
    "AG21": ("operators.reports.unpivot_metrics", ["unpivot_method_metrics"]),
    "AG22": ("operators.reports.distinct_count", ["distinct_processors"]),
    "AG23": ("operators.routing.rate_by_segment", ["rate_by_method_routed", "rate_by_device_routed"]),
    "AG24": ("operators.stats.strategy_summary", ["ab_strategy_summary"]),
    "AG25": ("operators.reports.mean_ci_bootstrap / mean_ci_normal", ["mean_ci_bootstrap_method", "mean_ci_normal_method"]),
    "AG26": ("operators.reports.combined_error_share", ["combined_error_share"]),
    "AG27": ("operators.reports.date_bounds", ["date_bounds"]),
    # 2.6 windows
    "WN1": ("operators.features.merchant_rolling_avg_amount", ["merchant_rolling_avg_amount"]),
    "WN2": ("operators.features.payment_method_rolling_success", [
        "payment_method_rolling_success", "payment_method_rolling_success_window", "sales_priority_rolling_failure",
        "sales_priority_rolling_failure_window"]),
    "WN3": ("operators.reports.rolling_daily_failure", ["rolling_7d_failure"]),
    "WN4": ("operators.reports.share_of_group", ["share_of_group_location_method"]),
    "WN5": ("operators.routing.moving_success", ["moving_success_500"]),
    "WN6": ("operators.features.previous_failures", ["previous_failures"]),
    "WN7": ("operators.routing.running_arm_stats", ["running_arm_stats"]),
    "WN8": ("operators.features.repeat_customer_rate", ["repeat_customer_rate"]),
    "WN9": ("operators.reports.period_over_period", ["period_over_period_week"]),
    "WN10": ("operators.reports.latest_k", ["latest_10"]),
    # 2.7 sorts, top-k, extremes
    "TK1": ("operators.reports.top_errors", ["top_errors"]),
    "TK2": ("operators.reports.extremes", ["extremes_payment_method", "extremes_processor", "extremes_location",
                                           "extremes_merchant"]),
    "TK3": ("operators.reports.top_by", ["peak_hours", "peak_days"]),
    "TK4": ("operators.reports.hours_above_q", ["hours_above_q75"]),
    "TK5": ("operators.reports.sort_by_weekday", ["sort_by_weekday"]),
    "TK6": ("operators.reports.value_counts", ["value_counts_method"]),
    "TK7": ("union of TK1-TK4 findings", ["find_summary"]),
    "TK8": ("operators.reports.head / sample_rows", ["head_10", "sample_rows_100"]),
    "TK9": ("operators.reports.sort_by_time", ["sort_by_time"]),
    # 2.8 statistical tests and business formulas
    "HT1": ("operators.stats.chi2_contingency", ["ab_chi2", "chi2_method_failure", "ab_chi2_pvalue",
                                                 "chi2_method_failure_pvalue"]),
    "HT2": ("operators.stats.ttest_ind", ["ab_ttest_processing_time", "ab_ttest_pvalue"]),
    "HT3": ("operators.stats.lift", ["ab_lift"]),
    "HT4": ("operators.stats.improvement_over_baseline", ["expected_success_vs_static"]),
    "HT5": ("operators.stats.cost_of_failures", ["cost_of_failures"]),
    "HT6": ("operators.stats.impact_roi", ["impact_roi"]),
    "HT8": ("operators.stats.target_gap", ["target_gap"]),
    # 2.9 ML
    "ML1": ("operators.ml.feature_pipeline", ["ml_feature_pipeline", "features_table", "features_model_input"]),
    "ML2": ("operators.ml.split", ["ml_split_counts", "ml_stratified_split_counts"]),
    "ML3": ("operators.ml.make_model('logistic')", ["ml_logistic_regression"]),
    "ML4": ("operators.ml.make_model('random_forest')", ["ml_random_forest"]),
    "ML5": ("operators.boosting.fit_boosted", ["ml_boosted_trees", "ml_boosted_importances", "ml_gradient_boosting"]),
    "ML6": ("operators.ml.make_model('mlp')", ["ml_mlp"]),
    "ML7": ("operators.ml.grid_search", ["ml_grid_search"]),
    "ML8": ("operators.ml.random_search", ["ml_random_search"]),
    "ML9": ("operators.ml.cross_validate / add_folds / cv_table", ["ml_fold_counts", "ml_cv_table"]),
    "ML10": ("operators.ml.binary_metrics", ["ml_confusion_feedback"]),
    "ML11": ("operators.ml.roc_auc / roc_points", ["ml_roc_auc_feedback", "ml_roc_pr_curve_feedback"]),
    "ML12": ("operators.ml.roc_points", ["ml_roc_pr_curve_feedback"]),
    "ML13": ("operators.ml.threshold_sweep", ["ml_threshold_sweep"]),
    "ML14": ("operators.ml.cost_sensitive", ["ml_cost_sensitive"]),
    "ML15": ("operators.smote.smote", ["ml_smote", "ml_smote_counts"]),
    "ML16": ("operators.ml.importances", ["ml_importances"]),
    "ML17": ("operators.shap.ranking", ["ml_shap_ranking", "ml_permutation_importance"]),
    "ML18": ("operators.ml.rfe", ["ml_rfe"]),
    "ML19": ("operators.ml.select_features", ["ml_select_features"]),
    "ML20": ("operators.ml.compare_models", ["ml_compare_models"]),
    "ML21": ("operators.ml.retrain", ["ml_retrain_and_score"]),
    "ML22": ("operators.ml.score_batch", ["ml_retrain_and_score"]),
    # 2.10 routing and experiments
    "RO1": ("operators.routing.processor_scores", ["processor_scores"]),
    "RO2": ("operators.routing.best_processor", ["best_processor"]),
    "RO3": ("operators.routing.argmax_arm (route_simple)", ["best_processor", "policy_eval"]),
    "RO4": ("operators.routing.route_capped", ["route_capped"]),
    "RO5": ("operators.routing.epsilon_greedy", ["route_epsilon_greedy"]),
    "RO6": ("operators.routing.ucb", ["route_ucb"]),
    "RO7": ("operators.routing.thompson / thompson_samples", ["route_thompson", "thompson_posterior"]),
    "RO8": ("operators.routing.static_baseline", ["static_baseline"]),
    "RO9": ("operators.routing.load_distribution", ["load_distribution"]),
    "RO10": ("operators.routing.policy_eval", ["policy_eval"]),
    "RO11": ("operators.routing.expected_success", ["expected_success_vs_static", "routing_all_policies_summary"]),
    "RO12": ("operators.routing.actual_vs_routed", ["actual_vs_routed"]),
    "RO13": ("operators.routing.ips_value", ["ips_value"]),
    "RO14": ("operators.routing.state_vector", ["state_vector"]),
    "RO15": ("operators.stats.rule_routing", ["rule_routing"]),
    "RO16": ("operators.stats.ab_assign", ["ab_outcomes"]),
    "RO17": ("operators.stats.adjusted_probability", ["ab_outcomes"]),
    "RO18": ("operators.routing.risk_rate", ["risk_rate_by_method"]),
    "RO19": ("operators.routing.volume_expectation", ["volume_expectation"]),
    # 2.11 monitoring
    "MN1": ("operators.monitor.calibration_table", ["calibration_table"]),
    "MN2": ("operators.monitor.calibration_error", ["calibration_error"]),
    "MN3": ("operators.monitor.drift_flag", ["drift_flag"]),
    "MN4": ("operators.monitor.error_log_summary", ["error_log_summary_24h"]),
    "MN5": ("operators.monitor.alerts", ["alerts"]),
    "MN6": ("operators.monitor.calibration_by_strategy", ["calibration_by_strategy"]),
    "MN7": ("operators.monitor.concept_drift_over_time", ["concept_drift_daily"]),
    "MN8": ("operators.monitor.retrain_on_drift", ["retrain_decision", "retrain_on_drift"]),
    # 2.12 streaming
    "SS1": ("streaming.streams.score_stream", ["stream_score"]),
    "SS2": ("streaming.streams.feedback_stream", ["stream_feedback_dedup"]),
    "SS3": ("streaming.streams.drift_stream", ["stream_drift_daily"]),
    "SS4": ("streaming.streams.error_stream", ["stream_error_windows"]),
    "SS5": ("streaming.bandit.route_stream", ["stream_route_bandit", "stream_arm_stats"]),
    "SS6": ("streaming.streams.outcome_stream", ["stream_prediction_outcomes", "stream_join_feedback"]),
}
