"""Fixed schemas of all documents, in canonical key order."""

from __future__ import annotations

from pyspark.sql import types as T

VERSIONS = {"source": "1.0.0", "audio_features": "1.0.0", "lyrics": "1.1.0", "video": "1.0.0", "structure": "1.0.0", "manifest": "1.3.0"}

SERIES = "struct<unit:string,start_seconds:double,hop_seconds:double,values:array<double>>"
ONSETS = "struct<times:array<double>,strengths:array<double>,strength_reference:double>"
CHANNEL = f"struct<rms_db:{SERIES},spectral_centroid_hz:{SERIES},onsets:{ONSETS}>"
USAGE = "struct<calls:int,input_tokens:bigint,output_tokens:bigint,usd:double,estimated_usd:double>"
RUN = f"struct<started_at:string,duration_seconds:double,tool_version:string,device:string,api_usage:{USAGE}>"
ENTRY = f"struct<status:string,path:string,schema_version:string,content_sha256:string,config_hash:string,run:{RUN},error:string>"

DDL = {
    "source": "schema_version string, track_id string, file struct<original_path:string,filename:string,size_bytes:bigint,sha256:string>, "
    "normalized_audio struct<path:string,sample_rate:int,channels:int,duration_seconds:double,audio_stream_sha256:string>, "
    "media struct<container:string,duration_seconds:double,tags:struct<title:string,artist:string>,audio:struct<codec:string,sample_rate:int,channels:int,bit_rate:int>,"
    "video:struct<codec:string,width:int,height:int,fps:double,frame_count:int>>, "
    "lyrics_input struct<path:string,format:string,sha256:string,line_count:int,has_timestamps:boolean>",
    "audio_features": "schema_version string, track_id string, duration_seconds double, tempo struct<bpm_global:double,confidence:double>, "
    f"beats struct<times:array<double>,beats_per_bar:int,downbeat_offset:int,downbeat_method:string>, loudness struct<integrated_lufs:double>, mix {CHANNEL}, "
    f"stems struct<vocals:{CHANNEL},drums:{CHANNEL},bass:{CHANNEL},other:{CHANNEL}>, "
    "vocal_activity struct<params:struct<enter_db:double,exit_db:double,min_region_seconds:double,min_gap_seconds:double>,"
    "regions:array<struct<start_seconds:double,end_seconds:double,mean_rms_db:double>>>",
    "lyrics": "schema_version string, track_id string, mode string, language string, engine struct<name:string,model:string,language_source:string>, "
    "lines array<struct<text:string,start_seconds:double,end_seconds:double,confidence:double,flags:array<string>,"
    "words:array<struct<text:string,start_seconds:double,end_seconds:double,confidence:double>>>>, "
    "supplied_markup array<struct<text:string,label:string,source_line_index:int,hint_seconds:double>>, "
    "untranscribed_regions array<struct<start_seconds:double,end_seconds:double>>, coverage struct<vocal_activity_covered_ratio:double,lines_flagged_ratio:double>",
    "video": "schema_version string, track_id string, video_span struct<start_seconds:double,end_seconds:double>, detector struct<name:string,threshold:double,min_shot_seconds:double>, "
    "caption_backend struct<name:string,model:string,prompt_version:string>, shots array<struct<index:int,start_seconds:double,end_seconds:double,start_frame:int,end_frame:int,"
    "representative_frames:array<struct<time_seconds:double,path:string,sha256:string>>,palette:array<struct<hex:string,proportion:double>>,motion:struct<mean:double,p95:double>,"
    "caption:struct<text:string,tags:array<string>>>>",
    "structure": "schema_version string, track_id string, sections array<struct<label:string,occurrence:int,start_seconds:double,end_seconds:double,start_beat_index:int,start_bar_index:int,"
    "confidence:double,evidence:array<string>>>, editing struct<on_beat_window_seconds:double,cuts_per_bar_global:double,on_beat_cut_ratio:double,"
    "per_section:array<struct<section_index:int,cuts_per_bar:double,on_beat_cut_ratio:double>>,cuts:array<struct<time_seconds:double,nearest_beat_index:int,offset_seconds:double>>>",
    "manifest": "schema_version string, track_id string, title string, artist string, has_video boolean, created_at string, "
    f"documents struct<source:{ENTRY},audio_features:{ENTRY},lyrics:{ENTRY},video:{ENTRY},structure:{ENTRY}>, "
    f"stems struct<status:string,retained:boolean,config_hash:string,run:{RUN},error:string,warning:string>",
}

#: Value domains as SQL predicates over a document's row; each must hold or be null.
CONSTRAINTS = {
    "source": ["track_id rlike '^[0-9a-f]{16}$'", "file.sha256 rlike '^[0-9a-f]{64}$'", "file.size_bytes >= 0", "schema_version rlike '^[0-9]+[.][0-9]+[.][0-9]+$'"],
    "audio_features": [
        "track_id rlike '^[0-9a-f]{16}$'",
        "tempo.bpm_global > 0",
        "tempo.confidence between 0 and 1",
        "mix.rms_db.hop_seconds > 0",
        "mix.onsets.strength_reference > 0",
        "beats.downbeat_method in ('assumed_4_4_phase_fit')",
    ],
    "lyrics": ["track_id rlike '^[0-9a-f]{16}$'", "mode in ('aligned', 'transcribed')", "coverage.vocal_activity_covered_ratio between 0 and 1", "coverage.lines_flagged_ratio between 0 and 1"],
    "video": [
        "track_id rlike '^[0-9a-f]{16}$'",
        "forall(shots, s -> size(s.representative_frames) between 1 and 2)",
        "forall(shots, s -> size(s.palette) between 1 and 5)",
        "forall(shots, s -> forall(s.palette, p -> p.hex rlike '^#[0-9a-f]{6}$'))",
    ],
    "structure": ["track_id rlike '^[0-9a-f]{16}$'", "forall(sections, s -> size(s.evidence) >= 1)"],
    "manifest": ["track_id rlike '^[0-9a-f]{16}$'", "documents.source.status in ('ok', 'pending', 'failed', 'not_applicable')"],
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def exported() -> dict[str, dict]:
    """All schemas as plain JSON values."""
    return {name: schema(name).jsonValue() for name in DDL}
