"""Schemas of the data model, as DDL."""

MANIFEST = "utt_id string, id string, audio_id string, token_ids array<int>, text string, feature_path string, audio_filepath string, num_frames int"
LENGTH_ENTRY = (
    "shard_name string, key string, utt_id string, split string, num_frames long, audio_member string, audio_format string, json_member string, "
    "audio_offset long, audio_size long, json_offset long, json_size long, wav_member string"
)
ALIGNMENT = "struct<token_id:int,token_text:string,start_encoder_t:int,end_encoder_t:int,start_frame:int,end_frame:int,start_ms:double,end_ms:double>"
DEBUG = "struct<feature_length:int,logit_length:int,pred_token_count:int,ref_token_count:int,blank_top1_ratio:double,avg_blank_prob:double>"
PREDICTION = (
    "utt_id string, pred_token_ids array<int>, ref_token_ids array<int>, pred_text string, ref_text string, score double, decode_strategy string, "
    f"ctc_score double, decoder_score double, combined_score double, mode string, alignments array<{ALIGNMENT}>, debug {DEBUG}"
)
BUCKET_MANIFEST = (
    "version int, root string, source_length_index_path string, bucket_width int, entries_per_part int, "
    "splits map<string, struct<num_samples: long, buckets: array<struct<bucket_id: int, num_samples: long, "
    "parts: array<struct<path: string, num_samples: long, first_shard: string, last_shard: string>>>>>>"
)
STEP_METRIC = "step long, epoch int, eval_loss double, eval_samples long, checkpoint_path string"
EPOCH_METRIC = "epoch int, step long, train_loss double, eval_loss double, eval_samples long, eval_full boolean, selection_metric double, selection_metric_name string"
TAR_MEMBER = "shard_name string, member string, key string, suffix string, offset long, size long, payload binary"
