"""DataFrame -> DataFrame operators.

detectors   rapid_drain, round_trip, fan_out / fan_in, dormant_activation,
            balance_inconsistency, high_velocity, drain_candidates, fan_candidates
analyze     analyze (all detectors, ``by=`` for many cases), register_detector,
            with_severity, to_payload
ledger_ops  filter_account(s), filter_steps, participations, account_history
findings    pattern_counts, findings_breakdown, top_findings, top_accounts,
            detection_rate, case_summary, case_list, merge_intervals, interval_join
timeline    timeline, annotate, narratives, timeline_json
graph       vertices, edges, ego_nodes / ego_edges / ego_network, styled,
            degree_centrality, betweenness
features    features, labelled_features
metrics     pr_curve, metrics, confusion, write_metrics
ml          stratified_split, class_weights, train, score, evaluate_all, rank_accounts,
            feature_importance, attribution, save / load
custody     digest_files, verify_files, digest_table, sign_records,
            verify_signatures, manifest_items, manifest_hash, finalize, finalize_rows,
            verify_manifest, custody_from_evidence, report_signature
report      report_cover, report_summary, report_evidence, report_findings,
            report_timelines, report_custody, report_custody_rows, report_tables, write_report
"""
