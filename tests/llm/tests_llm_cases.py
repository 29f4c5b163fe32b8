ODD_SQL = ["op1_source_mix", "op4_quality_rules", "op6_licence_scan"]
