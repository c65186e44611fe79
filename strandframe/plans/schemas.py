"""Schemas of the long-form tables and of the file formats."""

from __future__ import annotations

SEQUENCES = "seq_id string, seq string, ord long, source string"
FASTQ = "ord long, read_id string, length int, seq string, quality string"
FEATURES = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes map<string,string>, ord long"
GENBANK = "contig string, locus_tag string, gene string, protein_id string, product string, start int, end int, strand int, qualifiers map<string,array<string>>"
TREE = "tree_id string, node_id int, parent_id int, child_ord int, name string, label string, branch_length double, is_leaf boolean"

# Column names of tool reports, in file order.
SCAN_COLUMNS = [
    "target_name", "target_accession", "query_name", "query_accession", "full_evalue", "full_score", "full_bias",
    "best_evalue", "best_score", "best_bias", "exp", "reg", "clu", "ov", "env", "dom", "rep", "inc", "description",
]
SCAN_DOUBLES = SCAN_COLUMNS[4:11]
SCAN_INTS = SCAN_COLUMNS[11:18]
DOMAIN_COLUMNS = [
    "target_name", "target_accession", "tlen", "query_name", "query_accession", "qlen", "full_evalue", "full_score", "full_bias",
    "domain_number", "domain_total", "c_evalue", "i_evalue", "domain_score", "domain_bias", "hmm_from", "hmm_to",
    "ali_from", "ali_to", "env_from", "env_to", "acc", "description",
]
DOMAIN_DOUBLES = ["full_evalue", "full_score", "full_bias", "c_evalue", "i_evalue", "domain_score", "domain_bias", "acc"]
DOMAIN_INTS = ["tlen", "qlen", "domain_number", "domain_total", "hmm_from", "hmm_to", "ali_from", "ali_to", "env_from", "env_to"]
BLAST12 = (
    "query string, subject string, identity double, length int, mismatches int, gap_opens int, query_start int, query_end int, "
    "subject_start int, subject_end int, evalue double, bit_score double"
)
BLAST9_COLUMNS = ["query", "subject_id", "subject_accession", "subject_title", "evalue", "bit_score", "identity", "coverage", "organism"]
BLAST9_DOUBLES = ["evalue", "bit_score", "identity", "coverage"]
STATUS_COLUMNS = ["busco_id", "status", "sequence", "score", "length", "url", "description"]
