"""Column contracts of the frames that pass between operators."""

PAGE_OPS = "seq long, op string, host_lba long, host_data_node long, fingerprint string"
RESPONSES = (
    "seq long, fingerprint string, ref_count long, ssd_lba long, node_idx int, host_lba_start long, "
    "host_lba_len long, host_data_node long, is_exec boolean, op string, hit boolean"
)
SSD_COMMANDS = (
    "seq long, fingerprint string, ref_count long, ssd_node long, ssd_lba_start long, ssd_lba_len long, "
    "node_idx int, ssd_op string"
)
FP_TABLE = "fingerprint string, ref_count long, ssd_lba long, bucket long, node_idx int"
